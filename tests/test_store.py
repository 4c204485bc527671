import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewater import errors
from tidewater.operators.embeddings import DigestProvider
from tidewater.plans.cli import main
from tidewater.plans.golden import GoldenDataset, recall_at_k, reciprocal_rank, run_evaluation
from tidewater.plans.ingest import ingest, rebuild_lexical, rebuild_vectors
from tidewater.plans.service import KnowledgeService, result_of
from tidewater.plans.tools import tools
from tidewater.sources.files import folder
from tidewater.sources.store import Store
from tidewater.streaming.follow import follow


@pytest.fixture()
def files(tmp_path):
    root = tmp_path / "docs"
    (root / "a").mkdir(parents=True)
    (root / "a" / "guide.md").write_text("\ufeff# Guide\n\nDeploy the payments-service.\n\n## Rollback\n\nUse rollback_job now.\n", "utf-8")
    (root / "b.TXT").write_text("plain words about rollback_job", "utf-8")
    (root / ".hidden.md").write_text("# Hidden\nsecret", "utf-8")
    (root / "c.png").write_bytes(b"\x89")
    (root / "link.md").symlink_to(root / "b.TXT")
    return root


def test_folder_reads_what_counts(spark, files):
    rows = folder(spark, "s", files).orderBy("relative_path").collect()
    assert [r.relative_path for r in rows] == [".hidden.md", "a/guide.md", "b.TXT"]
    assert rows[1].content.startswith("# Guide")
    with pytest.raises(errors.SourceConfigurationError):
        folder(spark, "s", files / "none")
    with pytest.raises(Exception, match="more than 10 bytes"):
        folder(spark, "s", files, max_file_bytes=10).collect()


def test_sync_search_and_vectors(spark, files, tmp_path):
    store = Store(spark, tmp_path / "store")
    first = ingest(store, "s", folder(spark, "s", files))
    assert (first.discovered, first.created, first.deleted) == (3, 3, 0)
    before = store.table("documents").orderBy("relative_path").collect()
    again = ingest(store, "s", folder(spark, "s", files))
    assert again.unchanged == 3 and store.table("documents").orderBy("relative_path").collect() == before
    assert ingest(store, "s", folder(spark, "s", files), max_chunk_chars=40).reprocessed == 3

    service = KnowledgeService(store, DigestProvider())
    found = service.search("rollback_job", max_results=1)
    assert found.status == "partial" and found.truncated and found.results[0]["lexical_rank"] == 1
    assert service.search("nothingatall").status == "empty"
    with pytest.raises(errors.VectorIndexUnavailableError):
        service.search("x", strategy="vector")
    with pytest.raises(errors.InvalidQueryError):
        service.search("x", max_results=26)

    fingerprint, n = rebuild_vectors(store, DigestProvider())
    assert n == store.table("chunks").count() and store.manifest()["vector"]["fingerprint"] == fingerprint
    hybrid = service.search("rollback_job", strategy="hybrid", max_results=3)
    assert hybrid.results[0]["rrf_score"] and [h["rank"] for h in hybrid.results] == [1, 2, 3]
    with pytest.raises(errors.VectorIndexIncompatibleError):
        KnowledgeService(store, DigestProvider(4)).search("x", strategy="vector")
    with pytest.raises(errors.VectorIndexIncompatibleError):
        ingest(store, "s", folder(spark, "s", files), provider=DigestProvider(4))
    (files / "b.TXT").write_text("other words", "utf-8")
    with pytest.raises(errors.VectorIndexIncompatibleError):
        ingest(store, "s", folder(spark, "s", files))
    (files / ".hidden.md").unlink()
    changed = ingest(store, "s", folder(spark, "s", files), provider=DigestProvider())
    assert (changed.updated + changed.reprocessed, changed.deleted) == (2, 1)
    assert store.table("vectors").count() == store.table("chunks").count() == store.table("lengths").count()

    ids = [r.document_id for r in service.documents_of("s").collect()]
    assert service.get_document(ids[0])["document_id"] == ids[0] and service.get_document("doc_x") is None
    named = tools(service)
    assert named["get_chunk"]("chunk_x") == {"found": False, "chunk": None}
    assert named["search_knowledge"]("words")["status"] == "success"
    read_only = Store(spark, tmp_path / "store", read_only=True)
    with pytest.raises(errors.StoreError):
        ingest(read_only, "s", folder(spark, "s", files))


def test_a_failed_sync_changes_nothing(spark, files, tmp_path):
    store = Store(spark, tmp_path / "store")
    ingest(store, "s", folder(spark, "s", files))
    manifest = store.manifest()
    (files / "bad.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="cannot read bad.md"):
        ingest(store, "s", folder(spark, "s", files))
    assert store.manifest() == manifest
    (tmp_path / "later").mkdir()
    (tmp_path / "later" / "MANIFEST.json").write_text(json.dumps({"schema_version": 9, "vector": None, "sources": {}}))
    for read_only in (False, True):
        with pytest.raises(errors.UnsupportedSchemaVersionError):
            Store(spark, tmp_path / "later", read_only=read_only)


def raw(spark, *rows):
    return spark.createDataFrame([("s", *r) for r in rows], "source_id string, relative_path string, content string")


def root(store):
    return Path(store.files.uri.removeprefix("file://"))


def tables_of(store):
    return sorted(str(p.relative_to(root(store))) for p in root(store).glob("*/*") if p.is_dir())


def test_a_sync_writes_only_what_changed(spark, tmp_path):
    store, provider = Store(spark, tmp_path / "store"), DigestProvider()
    ingest(store, "s", raw(spark, ("a.md", "# A\none"), ("b.md", "# B\ntwo"), ("c.txt", "three"), ("e.txt", "five")))
    rebuild_vectors(store, provider)
    before, manifest = tables_of(store), store.manifest()
    assert ingest(store, "s", raw(spark, ("a.md", "# A\none"), ("b.md", "# B\ntwo"), ("c.txt", "three"), ("e.txt", "five"))).unchanged == 4
    assert tables_of(store) == before and store.manifest() == manifest
    done = ingest(store, "s", raw(spark, ("a.md", "# A\none"), ("b.md", "# B\nchanged"), ("e.txt", "five")), provider=provider)
    assert (done.created, done.updated, done.deleted, done.unchanged) == (0, 1, 1, 2)
    new = [t for t in tables_of(store) if t not in before]
    assert sorted(t.split("/")[0] for t in new) == ["blocks", "chunks", "documents", "gone", "groups", "lengths", "postings", "vectors"]
    assert spark.read.parquet(str(root(store) / next(t for t in new if t.startswith("chunks")))).count() == 1

    for k in range(6):
        ingest(store, "s", raw(spark, ("a.md", "# A\none"), ("b.md", f"# B\nagain {k}"), *[(f"n{i}.md", f"more {i} one") for i in range(k)]), provider=provider)
        assert sorted(r.text for r in store.table("chunks").collect()) == sorted(["# A\none", f"# B\nagain {k}", *[f"more {i} one" for i in range(k)]])
    assert len(store.manifest()["sources"]["s"]["parts"]) < 6
    fresh = Store(spark, tmp_path / "fresh")
    ingest(fresh, "s", raw(spark, ("a.md", "# A\none"), ("b.md", f"# B\nagain {k}"), *[(f"n{i}.md", f"more {i} one") for i in range(k)]))
    rebuild_vectors(fresh, provider)
    for name in ("chunks", "postings", "lengths", "vectors"):
        # pivots are each store's own
        rows = [sorted(map(repr, s.table(name).drop("pivot", "pivot_distance").collect())) for s in (store, fresh)]
        assert rows[0] == rows[1], name
    assert store.table("groups").agg(F.sum("n")).first()[0] >= k + 2
    # what is gone is no longer counted
    spread = [{r[0]: r[1] for r in s.table("blocks").groupBy("term").agg(F.sum("n_chunks")).filter("sum(n_chunks) <> 0").collect()} for s in (store, fresh)]
    assert spread[0] == spread[1] and store.stats() == fresh.stats()
    for query in ("one", "again more", "again/8 b"):
        found = [KnowledgeService(s).search(query, max_results=5).results for s in (store, fresh)]
        assert found[0] == found[1] and found[0]
    found = [KnowledgeService(s, provider).search("again", strategy="vector", max_results=4).results for s in (store, fresh)]
    assert found[0] == found[1] and len(found[0]) == 4


def test_what_a_sync_refuses(spark, tmp_path):
    store = Store(spark, tmp_path / "store")
    with pytest.raises(errors.IngestionError, match="several contents"):
        ingest(store, "s", raw(spark, ("a.md", "one"), ("./a.md", "two")))
    assert ingest(store, "s", raw(spark, ("a.md", "one"), ("./a.md", "one"))).created == 1
    for bad, error in ((("", raw(spark)), errors.SourceConfigurationError), (("t", raw(spark, ("a.md", "x"))), errors.IngestionError), (("s", raw(spark, ("a.md", None))), errors.IngestionError), (("s", raw(spark, ("a.pdf", "x"))), errors.UnsupportedDocumentFormatError), (("s", raw(spark, ("../a.md", "x"))), errors.IngestionError)):
        with pytest.raises(error):
            ingest(store, *bad)
    assert store.table("documents").count() == 1


def test_lost_postings_are_made_anew_and_corrupt_rows_are_found(spark, tmp_path):
    store = Store(spark, tmp_path / "store")
    ingest(store, "s", raw(spark, ("a.md", "# A\nalpha beta"), ("b.md", "beta")))
    service, manifest = KnowledgeService(store), store.manifest()
    found = service.search("beta").results
    lost = json.loads(json.dumps(manifest))
    del lost["sources"]["s"]["parts"][0]["tables"]["postings"]
    store.publish(lost)
    with pytest.raises(errors.IndexUnavailableError):
        service.search("beta")
    assert rebuild_lexical(store) == 2 and service.search("beta").results == found
    chunk, document = found[0]["chunk_id"], found[0]["document_id"]
    bad = store.table("chunks").withColumn("text", F.lit("not what was written"))
    spoilt = store.manifest()
    spoilt["sources"]["s"]["parts"][0]["tables"]["chunks"] = store.write("chunks", "s", bad)
    store.publish(spoilt)
    for read in (lambda: service.get_chunk(chunk), lambda: service.search("beta")):
        with pytest.raises(errors.StoreError, match="corrupt in text"):
            read()
    for read in (lambda: service.chunks_of(document).collect(), lambda: service.chunks_of(document).select("ordinal").collect()):
        with pytest.raises(Exception, match="corrupt in text: chunk_"):
            read()
    assert service.documents_of("s").count() == 2
    bad = store.table("documents").withColumn("title", F.lit(" ")).withColumn("processing_fingerprint", F.lit("x\n"))
    spoilt = store.manifest()
    spoilt["sources"]["s"]["parts"][0]["tables"]["documents"] = store.write("documents", "s", bad)
    store.publish(spoilt)
    with pytest.raises(Exception, match="corrupt in processing_fingerprint, title: doc_"):
        service.documents_of("s").collect()


def test_texts_are_read_for_the_chosen_chunks_only(spark, tmp_path):
    """No text enters a join before the limit."""
    store = Store(spark, tmp_path / "store")
    ingest(store, "s", raw(spark, ("a.md", "# A\nalpha beta"), ("b.md", "beta")))
    plan = KnowledgeService(store).lexical("beta", 1)._jdf.queryExecution().optimizedPlan().toString()
    limit = next(k for k, line in enumerate(plan.splitlines()) if "GlobalLimit" in line)
    below = [line for line in plan.splitlines()[limit:] if "Relation" in line or "Project" in line]
    inner = plan.splitlines()[limit]
    depth = len(inner) - len(inner.lstrip(" :+-"))
    below = [x for x in plan.splitlines()[limit + 1 :] if len(x) - len(x.lstrip(" :+-")) > depth]
    assert below and not any("text#" in x for x in below if "Project" in x)


def test_stream_with_vectors_and_rows_of_another_source(spark, tmp_path):
    store, provider = Store(spark, tmp_path / "store"), DigestProvider()
    ingest(store, "s", raw(spark, ("a.md", "one")))
    rebuild_vectors(store, provider)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"source_id": "s", "relative_path": "b.md", "content": "two"}))
    arriving = spark.readStream.schema("source_id string, relative_path string, content string").json(str(tmp_path / "in"))
    follow(arriving, store, "s", checkpoint=str(tmp_path / "cp"), provider=provider, available_now=True).awaitTermination()
    assert store.table("vectors").count() == 2 == store.table("documents").count()
    (tmp_path / "in" / "2.json").write_text(json.dumps({"source_id": "t", "relative_path": "c.md", "content": "three"}))
    with pytest.raises(Exception, match="not of source s"):
        follow(arriving, store, "s", checkpoint=str(tmp_path / "cp"), provider=provider, available_now=True).awaitTermination()
    assert store.table("documents").count() == 2


def test_stream_upserts(spark, tmp_path):
    store = Store(spark, tmp_path / "store")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"source_id": "s", "relative_path": "a.md", "content": "one"}))
    arriving = spark.readStream.schema("source_id string, relative_path string, content string").json(str(tmp_path / "in"))
    follow(arriving, store, "s", checkpoint=str(tmp_path / "cp"), available_now=True).awaitTermination()
    (tmp_path / "in" / "2.json").write_text(json.dumps({"source_id": "s", "relative_path": "b.md", "content": "two"}))
    follow(arriving, store, "s", checkpoint=str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert [r.relative_path for r in KnowledgeService(store).documents_of("s").collect()] == ["a.md", "b.md"]


def golden(tmp_path, occurrence=0):
    reference = {"source_id": "s", "relative_path": "a/guide.md", "section_path": ["Guide", "Rollback"], "section_occurrence": occurrence, "ordinal_in_section": 0}
    data = {"source_id": "s", "max_chunk_chars": 1000, "queries": [{"query_id": "q", "query": "rollback_job", "category": "lexical", "relevant": [reference]}]}
    path = tmp_path / "golden.json"
    path.write_text(json.dumps(data))
    return path


def test_evaluation(spark, files, tmp_path):
    assert recall_at_k(["a", "b"], ["b", "c"], 2) == 0.5 and reciprocal_rank(["a", "b"], ["b"]) == 0.5 and reciprocal_rank([], ["b"]) == 0.0
    store = Store(spark, tmp_path / "store")
    ingest(store, "s", folder(spark, "s", files))
    service = KnowledgeService(store)
    report = run_evaluation(service, GoldenDataset.load(golden(tmp_path)), strategies=("lexical",))
    assert report.strategies[0]["mean_recall_at_k"] == 1.0 and report.strategies[0]["category_breakdown"][1]["query_count"] == 0
    with pytest.raises(errors.EvaluationDatasetError):
        run_evaluation(service, GoldenDataset.load(golden(tmp_path, 5)))


def test_result_statuses():
    assert [result_of("lexical", [{}] * n, 2).status for n in (0, 2, 3)] == ["empty", "success", "partial"]


def test_command_line(spark, files, tmp_path, capsys):
    config = tmp_path / "c.toml"
    config.write_text('[source]\nsource_id = "s"\nroot = "docs"\n[persistence]\ndb_path = "store"\n[embeddings]\nenabled = true\nprovider = "fake"\n')
    run = lambda *a: (main([*a, "--config", str(config)], spark), capsys.readouterr())
    assert run("ingest", "--json")[0] == 0
    code, out = run("search", "rollback_job")
    assert code == 0 and out.out.startswith("success: ") and "\tGuide > Rollback\t" in out.out
    assert run("rebuild-vectors")[0] == 0
    code, out = run("evaluate", "--dataset", str(golden(tmp_path)))
    assert code == 0 and "hybrid\tlexical\t1\t1\t" in out.out
    code, out = run("search", " ")
    assert code == 1 and out.err.startswith("error: ")
    config.write_text("[processing]\nno = 1\n")
    assert run("ingest")[0] == 1
