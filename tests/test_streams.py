"""A stream that is run again reads only what is new and goes on from its table."""

import hashlib

from lexmesh.sources.keyed import KeyedTable
from lexmesh.streaming import query_log


def test_second_run_reads_only_new_files(spark, tmp_path):
    folder, run = tmp_path / "in", str(tmp_path / "job")
    table = folder / "documents.parquet"
    schema = "doc_id long, lang string, text string"
    spark.createDataFrame([(1, "es", "a"), (2, "es", "b")], schema).coalesce(1).write.mode("append").parquet(str(table))
    assert query_log.ingest_documents(spark, str(folder), run).count() == 2
    spark.createDataFrame([(2, "es", "c"), (3, "en", "d")], schema).coalesce(1).write.mode("append").parquet(str(table))
    got = {r["doc_id"]: r["hash"] for r in query_log.ingest_documents(spark, str(folder), run).collect()}
    assert got == {k: hashlib.md5(t.encode()).hexdigest() for k, t in ((1, "a"), (2, "c"), (3, "d"))}
    assert {r["doc_id"]: r["hash"] for r in query_log.ingest_documents(spark, str(folder), run).collect()} == got
    table = KeyedTable(spark, f"{run}/table", ["doc_id"])
    assert len(table.versions()) == 2 and table.read().where("updated_at is null").count() == 0


def files(folder):
    return {p for p in folder.rglob("*.parquet") if "version=" in str(p)}


def test_a_change_of_one_row_writes_one_bucket(spark, tmp_path):
    folder = tmp_path / "keyed"
    table = KeyedTable(spark, str(folder), ["id"], spark.createDataFrame([], "id long, v string").schema, buckets=8)
    assert table.read().columns == ["id", "v", "updated_at"] and table.read().count() == 0
    table.upsert(spark.createDataFrame([(i, "a") for i in range(200)] + [(None, "n")], "id long, v string"))
    before, stamps = files(folder), {r.id: r.updated_at for r in table.read().collect()}
    assert len({p.parent.name for p in before}) == 8 and len(stamps) == 201
    for _ in range(2):  # the second time it is the same change
        assert len(table.upsert(spark.createDataFrame([(7, "b")], "id long, v string"), number=1)) == 1
        new = files(folder) - before
        assert len({p.parent for p in new}) == 1 and all("version=1" in str(p) for p in new)
        now = {r.id: (r.v, r.updated_at) for r in table.read().collect()}
        assert len(now) == 201 and now[7][0] == "b" and now[7][1] > stamps[7] and all(now[i] == ("a", stamps[i]) for i in range(200) if i != 7)
    table.upsert(spark.createDataFrame([(None, "n")], "id long, v string"))
    table.delete(spark.createDataFrame([(i,) for i in range(0, 200, 2)], "id long"))
    assert {r.id for r in table.read().collect()} == {None, *range(1, 200, 2)}
    table.delete(spark.createDataFrame([(i,) for i in range(1, 200, 2)], "id long"))
    assert [r.id for r in table.read().collect()] == [None]
    for v in "cde":
        table.upsert(spark.createDataFrame([(1, v)], "id long, v string"))
    assert {r.id: r.v for r in table.read().collect()} == {None: "n", 1: "e"} and len(table.versions()) == 2
