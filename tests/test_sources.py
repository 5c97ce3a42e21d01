import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessella import sources, streaming


def mtx(folder):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / "matrix.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%remark\n3 2 4\n1 1 5\n2 1 1\n3 2 7\n1 2 2\n")
    with gzip.open(folder / "features.tsv.gz", "wt") as f:
        f.write("E1\tA\tGene\nE2\tB\tGene\nE3\tC\tGene\n")
    with gzip.open(folder / "barcodes.tsv.gz", "wt") as f:
        f.write("AAA\nBBB\n")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_mtx(spark, tmp_path):
    mtx(tmp_path)
    t = sources.read_mtx(spark, str(tmp_path))
    assert rows(t["expr"], "cell_id", "gene_id", "value") == [(0, 0, 5.0), (0, 1, 1.0), (1, 0, 2.0), (1, 2, 7.0)]
    assert rows(t["genes"], "gene_id", "gene_name") == [(0, "A"), (1, "B"), (2, "C")]
    assert rows(t["cells"], "cell_id", "cell_name") == [(0, "AAA"), (1, "BBB")]


def test_visium(spark, tmp_path):
    mtx(tmp_path / "filtered_feature_bc_matrix")
    (tmp_path / "spatial").mkdir()
    (tmp_path / "spatial/scalefactors_json.json").write_text(json.dumps({"tissue_lowres_scalef": 0.1}))
    (tmp_path / "spatial/tissue_positions_list.csv").write_text("AAA,1,3,5,100,200\nBBB,0,4,6,10,20\n")
    t = sources.read_visium(spark, str(tmp_path))
    r = t["cells"].first()
    assert t["cells"].count() == 1 and (r.cell_name, r.x, r.y, r.x_um, r.y_um) == ("3x5", 20.0, 10.0, 250.0, 0.0)
    assert t["expr"].count() == 2


def test_platforms(spark, tmp_path):
    x = tmp_path / "xenium"
    mtx(x / "cell_feature_matrix")
    (x / "cells.csv").write_text("cell_id,x_centroid,y_centroid\nBBB,1,2\nAAA,3,4\n")
    assert rows(sources.read_xenium(spark, str(x))["cells"], "cell_name", "x", "y") == [("AAA", 3.0, 4.0), ("BBB", 1.0, 2.0)]
    (x / "cells.csv").write_text("cell_id,x_centroid,y_centroid\nBBB,1,2\n")
    with pytest.raises(KeyError):
        sources.read_xenium(spark, str(x))
    c = tmp_path / "cosmx"
    c.mkdir()
    (c / "a_exprMat_file.csv").write_text("fov,cell_ID,G1,G2\n1,1,3,0\n1,2,0,4\n2,1,1,1\n")
    (c / "a_metadata_file.csv").write_text("fov,cell_ID,CenterX_local_px,CenterY_local_px,CenterX_global_px,CenterY_global_px\n1,1,0,0,10,20\n1,2,0,0,30,40\n2,1,0,0,50,60\n")
    t = sources.read_cosmx(spark, str(c), fov=1)
    assert rows(t["cells"], "cell_name", "x", "y") == [("1_1", 10.0, 20.0), ("1_2", 30.0, 40.0)] and t["expr"].count() == 2
    m = tmp_path / "merscope"
    m.mkdir()
    (m / "cell_by_gene.csv").write_text("cell,G1,G2\nu,1,0\nv,0,2\n")
    (m / "cell_metadata.csv").write_text("id,center_x,center_y\nu,5,6\n")
    assert {r.cell_name: r.x for r in sources.read_merscope(spark, str(m))["cells"].collect()} == {"u": 5.0, "v": None}


def test_round_trips(spark, tmp_path):
    tables = sources.synthetic_data(spark, 20, 6, 3, sparsity=0.5, seed=3)
    sources.write_spatial_csv(tables, str(tmp_path))
    back = sources.read_spatial(spark, f"{tmp_path}/spatial_counts", f"{tmp_path}/spatial_coordinates")
    named = lambda t: rows(t["expr"].join(t["cells"], "cell_id").join(t["genes"], "gene_id"), "cell_name", "gene_name", "value")
    assert named(back) == named(tables)
    sources.write_tables(tables, f"{tmp_path}/tables")
    assert spark.read.parquet(f"{tmp_path}/tables/expr").count() == tables["expr"].count()
    sources.export_spatial(tables, f"{tmp_path}/export")
    assert spark.read.parquet(f"{tmp_path}/export/points").first().wkt.startswith("POINT (")


def test_gmt(spark, tmp_path):
    (tmp_path / "a.gmt").write_text("s1\td\tA\tB\ns2\td\tC\nshort\td\ns1\td\tZ\n")
    sets = sources.read_gmt(spark, str(tmp_path / "a.gmt"))
    assert {r.set_name: r.genes for r in sets.collect()} == {"s1": ["Z"], "s2": ["C"]}
    sources.write_gmt(sets, f"{tmp_path}/out")
    assert {r.set_name: r.genes for r in sources.read_gmt(spark, f"{tmp_path}/out").collect()} == {"s1": ["Z"], "s2": ["C"]}


def test_spots_and_signatures(spark):
    counts = spark.createDataFrame([("A", 1, 0), ("B", 2, 3)], "gene string, s1 int, s2 int")
    where = spark.createDataFrame([("s1", 1.0, 2.0), ("s2", 3.0, 4.0)], "spot string, X double, Y double")
    t = sources.create_spots(counts, where)
    assert t["expr"].count() == 3 and rows(t["cells"], "cell_name", "x") == [("s1", 1.0), ("s2", 3.0)]
    with pytest.raises(ValueError):
        sources.create_spots(counts, where.where("spot = 's1'"))
    d = spark.createDataFrame([("CNA", 0, "LIHC_x", "g", 1.0), ("expr", 1, "PANCAN", "h", 2.0)], "kind string, pos int, name string, gene string, weight double")
    assert [sources.cancer_signature(d, c).first().kind for c in ("LIHC", "BRCA")] == ["CNA", "expr"]
    assert sources.cancer_signature(d.where("kind = 'CNA'"), "BRCA").first().kind == "seq_depth"


def test_synthetic(spark):
    a, b = (sources.spatial_clusters(spark, 30, 3, 12, seed=1) for _ in range(2))
    assert rows(a["expr"], "cell_id", "gene_id", "value") == rows(b["expr"].repartition(5), "cell_id", "gene_id", "value")
    assert a["cells"].where("x < 0 or x > 1000").isEmpty()
    up = a["expr"].join(a["cells"], "cell_id").where("cluster = 'cluster_0'").groupBy((F.col("gene_id") < 4).alias("own")).agg(F.avg("value").alias("v")).collect()
    by = {r.own: r.v for r in up}
    assert by[True] > by[False] + 2
    pixels, image = sources.cells_image(spark, 3, (64, 64), (4, 6))
    assert pixels.select("label").distinct().count() == 3 and image.count() == 64 * 64


def test_streams_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = streaming.event_windows(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("tessella_windows").start()
    q.processAllAvailable()
    q.stop()
    key = (F.col("start").cast("string"), "event_type", "n")
    assert rows(spark.table("tessella_windows"), *key) == rows(streaming.event_windows(events), *key)
    pixels = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "row int, col int, label int")
    t = events.select((F.col("user_id") % 2).cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("event_type").alias("gene"))
    t.write.parquet(f"{tmp_path}/t")
    s = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/t")
    q = streaming.transcript_counts(s, pixels, 1, 2).writeStream.outputMode("complete").format("memory").queryName("tessella_counts").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("tessella_counts"), "label", "gene", "n") == rows(streaming.transcript_counts(t, pixels, 1, 2), "label", "gene", "n")
    assert streaming.distinct_events(events.union(events)).count() == events.count()
