"""Stores of earlier versions, several writers, what is removed, and what a sync or lookup costs."""

import json
import math
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewater import errors
from tidewater.operators.embeddings import DigestProvider
from tidewater.plans import ingest as ingests
from tidewater.plans import migration
from tidewater.plans.ingest import ingest, rebuild_vectors
from tidewater.plans.service import KnowledgeService
from tidewater.sources.shared_files import SharedFolder
from tidewater.sources.store import FAN, SCHEMAS, Store, due, tier


def raw(spark, *rows, source="s"):
    return spark.createDataFrame([(source, *r) for r in rows], "source_id string, relative_path string, content string")


def root(store):
    return Path(store.files.uri.removeprefix("file://"))


DOCUMENTS = [("a.md", "# A\nalpha beta gamma"), ("b/b.md", "# B\nbeta\n## C\nalpha delta-e"), ("c.txt", "plain beta")]


# --- versions ----------------------------------------------------------------------


def old_store(spark, new, path, version, *, gone=False):
    """A store as versions 1 and 2 wrote it, from a new one's tables."""
    path.mkdir()
    tables = {}
    for name in ("documents", "chunks", "vectors"):
        df = new.table(name).drop("pivot", "pivot_distance")
        parts = [df] if version == 1 or not gone else [df.unionByName(df.withColumn("document_id", F.lit("doc_" + "0" * 24)).limit(1)), None]
        for k, part in enumerate(parts):
            if part is not None:
                part.write.parquet(str(path / name / f"x-{k}"))
        tables[name] = f"{name}/x-0" if version == 1 else [[f"{name}/x-0", 1]]
    if version == 1:
        for name in ("postings", "lengths"):
            spark.createDataFrame([], "chunk_id string").write.parquet(str(path / name / "x"))
            tables[name] = f"{name}/x"
    elif gone:
        spark.createDataFrame([("doc_" + "0" * 24,)], "document_id string").write.parquet(str(path / "gone" / "x"))
        tables["gone"] = [["gone/x", 2]]
    entry = {"source_type": "local_filesystem", "display_name": None, "tables": tables} | ({"delta": 2, "stats": {"chunks": 0, "tokens": 0}} if version == 2 else {})
    (path / "MANIFEST.json").write_text(json.dumps({"schema_version": version, "vector": {k: v for k, v in new.manifest()["vector"].items() if k != "pivots"}, "sources": {"s": entry}}))


@pytest.mark.parametrize(("version", "gone"), [(1, False), (2, False), (2, True)])
def test_a_store_of_an_earlier_version_is_migrated(spark, tmp_path, monkeypatch, version, gone):
    new, provider = Store(spark, tmp_path / "new"), DigestProvider()
    ingest(new, "s", raw(spark, *DOCUMENTS))
    rebuild_vectors(new, provider)
    old_store(spark, new, tmp_path / "old", version, gone=gone)
    with pytest.raises(errors.UnsupportedSchemaVersionError, match="only migrated"):
        Store(spark, tmp_path / "old", read_only=True)

    # a step that fails leaves the version before
    def fails(store, manifest):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setitem(migration.STEPS, 2, fails)
        with pytest.raises(OSError, match="disk full"):
            Store(spark, tmp_path / "old")
    kept = json.loads((tmp_path / "old" / "MANIFEST.json").read_text())
    assert kept["schema_version"] == version
    store = Store(spark, tmp_path / "old")
    assert store.manifest()["schema_version"] == 3 and store.stats() == new.stats()
    for name in ("documents", "chunks", "postings", "lengths", "vectors"):
        assert sorted(map(repr, store.table(name).collect())) == sorted(map(repr, new.table(name).collect())), name
    found = [KnowledgeService(s, provider).search("beta alpha", strategy="hybrid").results for s in (store, new)]
    assert found[0] == found[1] and found[0]
    # the chain is over, and syncs go on from it
    number = store.manifest()["number"]
    assert store.table("groups").agg(F.sum("n")).first()[0] == 4
    assert Store(spark, tmp_path / "old").manifest()["number"] == number
    assert ingest(store, "s", raw(spark, *DOCUMENTS), provider=provider).unchanged == 3
    assert ingest(store, "s", raw(spark, *DOCUMENTS[1:]), provider=provider).deleted == 1


# --- several writers ---------------------------------------------------------------


def test_a_manifest_is_made_once(spark, tmp_path):
    files = SharedFolder(spark, tmp_path / "x y")
    files.make()
    assert files.create("a", "one") and not files.create("a", "two") and files.read("a") == "one"
    # as on file systems without hard links
    files._local = False
    assert files.create("b", "three") and not files.create("a", "four") and (files.read("a"), files.read("b")) == ("one", "three")
    assert [name for name, _ in files.entries()] == ["a", "b"] and files.entries("none") == []
    with pytest.raises(errors.StoreError):
        files.read("none")


def test_two_writers_of_one_source_and_of_two(spark, tmp_path, monkeypatch):
    uri = f"file:{tmp_path}/store"
    store, other = Store(spark, uri), Store(spark, uri)
    ingest(store, "s", raw(spark, ("a.md", "one")))
    began, taken = [], ingests._part

    def between(*args):
        """What the other writer does while this one is at work."""
        done = taken(*args)
        if not began:
            began.append(1)
            ingest(other, source, raw(spark, ("b.md", "two"), source=source), keep_missing=True)
        return done

    monkeypatch.setattr(ingests, "_part", between)
    source = "t"
    assert ingest(store, "s", raw(spark, ("a.md", "one"), ("c.md", "three"))).created == 1
    assert {r.relative_path for r in store.table("documents").collect()} == {"a.md", "b.md", "c.md"} and len(began) == 1
    # of the same source: the second begins again from what the first published, and its snapshot deletes b.md
    began.clear()
    source = "s"
    done = ingest(store, "s", raw(spark, ("a.md", "one"), ("c.md", "changed")))
    assert (done.updated, done.deleted) == (1, 1)
    assert {(r.source_id, r.relative_path) for r in store.table("documents").collect()} == {("s", "a.md"), ("s", "c.md"), ("t", "b.md")}
    began.clear()
    monkeypatch.setattr(ingests, "ATTEMPTS", 1)
    with pytest.raises(errors.StoreConflictError):
        ingest(store, "s", raw(spark, ("d.md", "four")))
    assert {r.relative_path for r in store.table("documents", "s").collect()} == {"a.md", "b.md", "c.md"}
    stale = store.manifest()
    store.publish(stale)
    with pytest.raises(errors.StoreConflictError):
        store.publish(stale)


def test_a_search_keeps_to_its_snapshot_and_old_tables_are_removed(spark, tmp_path):
    store = Store(spark, tmp_path / "store")
    ingest(store, "s", raw(spark, *DOCUMENTS))
    view, first = store.pinned(), store.manifest()
    ingest(store, "s", raw(spark, ("a.md", "other")))
    assert view.table("documents").count() == 3 and store.table("documents").count() == 1
    with pytest.raises(errors.StoreError):
        view.write("documents", "s", store.table("documents"))
    store.write("chunks", "s", store.table("chunks"))  # as a writer leaves that fails
    assert store.collect() == [] and view.table("chunks").count() == 4
    for _ in range(3):
        ingest(store, "s", raw(spark, ("a.md", f"again {time.time()}")))
    kept = {p for part in store.manifest()["sources"]["s"]["parts"] for p in part["tables"].values()}
    removed = store.collect(grace_seconds=-1)
    left = {str(p.relative_to(root(store))) for name in SCHEMAS for p in (root(store) / name).glob("*")}
    assert left == kept and len(list((root(store) / "manifests").glob("*.json"))) == 1
    assert f"manifests/{first['number']:020d}.json" in removed and sum(n.startswith("chunks/") for n in removed) >= 2
    assert [r["chunk_id"] for r in KnowledgeService(store).search("again").results] == [r.chunk_id for r in store.table("chunks").collect()]
    assert store.collect(grace_seconds=-1) == []


# --- costs -------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [[1] * 256, [1, 16] * 64, [1000, *[1] * 255], list(range(1, 200)), [64, 1, 1, 9] * 30, [3] * 64])
def test_parts_of_like_size_are_merged(sizes):
    """Each row is written a few times a tier, and few parts are left."""
    parts, written, total = [], 0, 0
    for s in sizes:
        parts.append(s)
        written, total = written + s, total + s
        if (k := due(parts)) > 1:
            parts[-k:] = [sum(parts[-k:])]
            written += parts[-1]
        tiers = [tier(p) for p in parts]
        assert tiers == sorted(tiers, reverse=True) and all(tiers.count(t) < FAN for t in tiers)
    assert sum(parts) == total and written <= total * (3 + math.log(total, FAN)) and len(parts) <= (FAN - 1) * (1 + math.log(total, FAN))


def scan_rows(df):
    """Rows that scans of Parquet let through before conditions are looked at, as the run counts them."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """3000 documents in files of 150."""
    at = tmp_path_factory.mktemp("large") / "store"
    store = Store(spark, at)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    rows = spark.range(3000).select(F.lit("s").alias("source_id"), F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".md")).alias("relative_path"), F.concat(F.lit("# T\nword w"), F.col("id").cast("string")).alias("content"))
    try:
        ingest(store, "s", rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return at


def test_a_chunk_is_found_by_its_id_in_few_row_groups(spark, large):
    store = Store(spark, large, read_only=True)
    row = store.table("chunks").orderBy("chunk_id").first()
    files = len(list((large / store.manifest()["sources"]["s"]["parts"][0]["tables"]["chunks"]).glob("*.parquet")))
    assert files >= 10
    found = store.table("chunks").filter(F.col("chunk_id") == row["chunk_id"])
    assert scan_rows(found) <= 2 * 3000 / files * 1.5
    assert KnowledgeService(store).get_chunk(row["chunk_id"])["text"] == row["text"] and KnowledgeService(store).get_chunk("chunk_none") is None


def test_an_upsert_looks_up_its_own_documents(spark, large):
    store = Store(spark, large)
    known = store.table("documents").select("document_id").limit(3)
    few = store.of_documents("documents", known, "s")
    assert few.count() == 3 and "In(document_id" in few._jdf.queryExecution().executedPlan().toString()
    many = store.of_documents("documents", store.table("documents").select("document_id").limit(1500), "s")
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert many.count() == 1500 and "FullOuter" not in plan and "LeftSemi" in plan
    before = store.manifest()
    done = ingest(store, "s", raw(spark, ("d/7.md", "# T\nchanged"), ("new.md", "word"), ("d/8.md", "# T\nword w8")), keep_missing=True)
    assert (done.created, done.updated, done.unchanged, done.deleted) == (1, 1, 1, 0)
    after = store.manifest()["sources"]["s"]
    assert after["parts"][0] == before["sources"]["s"]["parts"][0] and after["parts"][1]["rows"] == 3
    whole = store.live("lengths", after["parts"]).agg(F.count("*"), F.sum("length")).first()
    assert tuple(whole) == (after["stats"]["chunks"], after["stats"]["tokens"]) == (3001, whole[1])
    # of w7's chunk nothing is counted any more
    assert store.table("blocks").filter("term = 'w7'").agg(F.sum("n_chunks")).first()[0] == 0
    assert KnowledgeService(store).search("w7").status == "empty" and KnowledgeService(store).search("changed").results[0]["relative_path"] == "d/7.md"


def test_a_search_reads_the_chosen_documents_only(spark, large, monkeypatch):
    service = KnowledgeService(Store(spark, large, read_only=True))
    view = service.store.pinned()
    found = service.lexical("w1234", 5, view)
    assert [r.relative_path for r in found.collect()] == ["d/1234.md"]
    chosen = [p for p in found._jdf.queryExecution().executedPlan().toString().split("FileScan")[1:] if "document_id" in p]
    assert chosen and all("document_id" in p.split("PushedFilters", 1)[1].split("]")[0] for p in chosen)
    ties = service.search("word", max_results=5)
    assert [r["relative_path"] for r in ties.results] == sorted(r.relative_path for r in view.table("documents").collect() if r.relative_path != "new.md")[:5] or ties.results[0]["relative_path"] == "new.md"
    # the same without conditions, where too many tie
    monkeypatch.setattr("tidewater.operators.lexical.FEW", 0)
    assert service.search("word", max_results=5).results == ties.results


def test_many_queries_at_once_find_what_each_finds(spark, tmp_path):
    """Words and phrases that queries share, ties, queries without a hit or a token, two sources, documents that are gone."""
    store, provider = Store(spark, tmp_path / "store"), DigestProvider()
    words = ["pay", "retry", "max_retry", "a/b", "timeout", "rollback"]
    texts = [(f"{k}.md", f"# H{k % 3}\n" + " ".join(words[(k * j) % 6] for j in range(1, 2 + k % 9))) for k in range(30)]
    ingest(store, "s", raw(spark, *texts))
    rebuild_vectors(store, provider)
    ingest(store, "s", raw(spark, *texts[:24], ("24.md", "pay pay")), provider=provider)
    ingest(store, "t", raw(spark, ("x.md", "pay retry a/b"), ("0.md", texts[0][1]), source="t"), provider=provider)
    service = KnowledgeService(store, provider)
    queries = {"1": "pay", "2": "retry a/b pay a/b", "4": "nothing", "5": "!!", "6": " rollback timeout/pay "}
    for strategy in ("lexical", "vector", "hybrid"):
        rows = service.search_each(queries, strategy, 4).collect()
        for q, text in queries.items():
            want = [h["chunk_id"] for h in service.search(text, strategy=strategy, max_results=4).results]
            assert [r["chunk_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] == want, (strategy, q)
    for bad in ({"1": " "}, {"1": "x" * 5}):
        with pytest.raises(errors.InvalidQueryError):
            service.search_each(bad, "lexical" if bad["1"] == " " else "best", 4)
    with pytest.raises(errors.VectorIndexUnavailableError):
        KnowledgeService(store).search_each(queries, "hybrid", 4)


def test_local_disk_of_a_store_has_no_stray_files(spark, tmp_path):
    store = Store(spark, tmp_path / "store")
    ingest(store, "s", raw(spark, ("a.md", "one")))
    assert {p.name for p in (root(store) / "manifests").iterdir() if not p.name.startswith(".")} == {f"{1:020d}.json"} and os.path.isdir(root(store))
