"""Prefix tries, WARC archives and centroid clusters against brute force, with damage, hot keys and edge cases."""

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.llm import queries, warc
from tidewater.llm.centroids import clusters, whole_vectors
from tidewater.llm.prefix_trie import prefix_trie, running

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_warc", "op13_centroid_clusters"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


# --- prefix trie -------------------------------------------------------------------


def trie_of(conversations):
    """conversations: id -> list of (role, text)."""
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    out = []
    for node, of in members.items():
        below = [m for m in members if m[: len(node)] == node]
        saved = sum((len(members[m]) - 1) * len((m[-1][1] if m else "").split()) for m in below)
        ends = ",".join(map(str, sorted(c for c in of if len(conversations[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), len(children[node]), sum(not children[m] for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def as_rows(conversations):
    return [(c, k, role, text) for c, turns in conversations.items() for k, (role, text) in enumerate(turns)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_brute_force(spark, seed):
    draw = random.Random(seed)
    said = [("user", "a b"), ("user", "c"), ("assistant", ""), ("", "d  e\tf"), ("assistant", "a b")]
    conversations = {c: [draw.choice(said) for _ in range(draw.choice([1, 2, 2, 3, 5, 9]))] for c in range(120)}
    conversations |= {c: [said[0]] * 3 for c in range(200, 260)}
    conversations[300] = [said[k % 5] for k in range(400)]
    rows = as_rows(conversations)
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("place", F.lit("y"))
    assert sorted(map(tuple, prefix_trie(df.repartition(5)).collect()), key=repr) == trie_of(conversations)


def test_trie_of_nulls_ties_and_no_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x y"), (1, 0, "user", "x y"), (2, None, "", ""), (None, 0, "user", "x"), (3, 5, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = trie_of({1: [("", ""), ("user", "x y"), ("user", "x y")], 2: [("", "")], 3: [("user", "x" * 100_000)]})
    assert sorted(map(tuple, prefix_trie(df).collect()), key=repr) == want
    assert prefix_trie(df.limit(0)).count() == 0


def test_running_sums_of_a_key_over_many_tasks(spark):
    n = 5000
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("key"), F.col("id").alias("at"), (F.col("id") * (1 << 50)).alias("x"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(df, ["key"], [F.col("at")], ["x"], "test").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    place, total = Counter(), Counter()
    want = []
    for i in range(n):
        key = 7 if i % 3 else i
        place[key] += 1
        before, total[key] = total[key], total[key] + i * (1 << 50)
        wrap = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
        want.append((key, i, place[key], wrap(total[key]), wrap(before)))
    assert sorted((r["key"], r["at"], r["place"], r["x"], r["x_before"]) for r in got) == sorted(want)


def test_rebuilt_conversations_are_those_of_the_contract(spark):
    """Base conversations that are short, absent or long; conversations that lose all their turns stay members of the root."""
    draw = random.Random(5)
    own = {c: [("user", f"w{draw.randrange(3)}") for _ in range(draw.choice([1, 2, 3, 4, 6]))] for c in [*range(0, 20), *range(21, 39), 40, 45, 46, 47, 48, 49, 60, 61, 62, 63]}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    assert any(not turns for turns in rebuilt.values())
    from tidewater.llm.prefix_trie import placed_turns, trie, turn_digests

    df = spark.createDataFrame(as_rows(own), "conv_id long, turn long, role string, text string")
    placed = placed_turns(turn_digests(df))
    ids = placed.select("conv_id").distinct()
    assert sorted(map(tuple, trie(queries.rebuilt(placed, ids), ids).collect()), key=repr) == trie_of(rebuilt)


# --- WARC --------------------------------------------------------------------------


@pytest.fixture()
def pages(spark):
    long = "<p>word</p>" * 60_000
    rows = [(k, f"http://host/{k}", f"<html>{k}" + "x" * (40 * k)) for k in range(30)]
    rows += [(100 + k, f"http://copy/{k}", "y" * 500) for k in range(40)] + [(200, None, None), (201, "http://a b\r\n/ü", ""), (202, "http://long", long), (203, "http://small", "z" * 99), (204, "http://small", "z" * 99)]
    rows += [(205, "http://ü", "ü" * 50), (206, "http://ü", "ü" * 50), (None, "http://null", "y" * 500), (7, "http://again", "<html>7" + "x" * 280)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumn("digest", F.lit("x")).withColumn("first", F.lit("x")).withColumn("payload", F.lit("x"))


def read_all(spark, files, **more):
    return warc.read_archives(spark.createDataFrame([(n, b) for n, b in files.items()], "path string, content binary"), **more)


def test_pages_come_back_from_archives(spark, pages):
    names = warc.write_archives(pages, archive_bytes=4000)
    assert names.count() > 4 and {r["path"].rpartition("/")[0] for r in names.collect()} != {""}
    records = warc.resolved(warc.read_archives(names))
    kept = records.filter("type in ('response', 'revisit')")
    ids = {name: warc.id_of_record(F.col(c), "long") for name, c in (("id", "record_id"), ("refers", "refers_to"))}
    got = [(r["id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers"]) for r in kept.withColumns(ids).collect()]
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    want = []
    for page, payload in rows:
        first = min((p for p, other in rows if other == payload and p is not None), default=None)
        again = len(payload) >= 100 and first is not None and (page is None or first < page)
        want.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert records.filter("not resolved").count() == 0
    whole = warc.read_archives(names).filter("type = 'response'").select("payload").collect()
    assert Counter(bytes(r["payload"]) for r in whole) == Counter(payload for (page, payload), w in zip(rows, want, strict=True) if w[3] == "response")
    assert warc.write_archives(pages.limit(0)).count() == 0


def member(k, text, packed=True):
    row = {"id": str(k), "refers_to": None, "url": f"http://x/{k}", "digest": hashlib.sha256(text).hexdigest(), "bytes": len(text), "payload": text}
    record = warc.page_record(row, "2020-01-01T00:00:00Z")
    return gzip.compress(record, mtime=0) if packed else record


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_only_what_it_hits(spark, packed):
    draw = random.Random(9)
    texts = [bytes(draw.randrange(256) for _ in range(3000)) for _ in range(12)]
    # a payload that holds a record of its own, as it is and compressed
    texts[5] = texts[5] + member(99, b"inner", packed) + texts[5]
    parts = [member(k, t, packed) for k, t in enumerate(texts)]
    starts = [sum(map(len, parts[:k])) for k in range(13)]
    name = "a.warc.gz" if packed else "a.warc"

    def damaged(change):
        data = bytearray(b"".join(parts))
        return bytes(change(data) or data)

    def flip(data):
        data[starts[3] + 1500] ^= 1  # within a payload
        data[starts[5] + 3010] ^= 1  # within the record that a payload holds

    def cut(data):
        return data[: starts[7] + 100] + data[starts[8] + 50 :]

    def junk(data):
        return b"\x1f\x8b\x08WARC/1.1\r\nno" + bytes(data[: starts[4]]) + b"WARC/1.1\r\n\x1f\x8b\x08" * 9 + bytes(data[starts[4] :]) + b"\0" * 64

    def head(data):
        return data[: starts[2]] + bytes(data[starts[2] : starts[3]]).replace(b"Content-Length: 3", b"Content-Length: 9") + data[starts[3] :] if not packed else data[: starts[2]] + data[starts[2] + 5 :]

    for change, lost in ((lambda d: None, set()), (flip, {3, 5}), (cut, {7, 8}), (junk, set()), (head, {2}), (lambda d: d[: starts[11] + 40], {11}), (lambda d: d[3:], {0})):
        data = damaged(change)
        rows = read_all(spark, {name: data}).collect()
        found = {int(r["record_id"].rpartition(":")[2][:-1]) for r in rows if r["reason"] is None}
        assert found == set(range(12)) - lost
        assert all(bytes(r["payload"]) == texts[int(r["record_id"].rpartition(":")[2][:-1])] for r in rows if r["reason"] is None)
        # records and gaps cover the file, without overlaps
        place = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place == len(data)
        assert bool(lost) <= (warc.quarantined(read_all(spark, {name: data})).count() > 0)


def test_a_lost_response_leaves_its_revisit_unresolved(spark):
    row = {"id": "2", "refers_to": "1", "url": "http://x", "digest": hashlib.sha256(b"gone").hexdigest(), "bytes": 4, "payload": b""}
    again = gzip.compress(warc.page_record(row, "2020-01-01T00:00:00Z"))
    got = warc.resolved(read_all(spark, {"a.warc.gz": again})).collect()
    assert [(r["type"], r["payload_bytes"], r["resolved"]) for r in got] == [("revisit", 4, False)]
    got = warc.resolved(read_all(spark, {"a.warc.gz": again, "b.warc.gz": member(1, b"gone")})).filter("type = 'revisit'").collect()
    assert [(r["payload_bytes"], r["resolved"]) for r in got] == [(4, True)]


def test_other_writers_records(spark):
    """SHA-1 in base 32, folded fields, other types, several names' cases; bounds on size; empty and missing files."""
    block = b"hello"
    sha1 = "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert warc.same_digest("sha1:VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N", b"hello") and not warc.same_digest(sha1 + "X", b"hello") and warc.same_digest("crc9:1", b"x")
    record = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: http://a\r\n b\r\nCONTENT-LENGTH: 5\r\n\r\n" + block + b"\r\n\r\n"
    rows = read_all(spark, {"a.warc": record, "b": record * 2, "c.warc.gz": b"", "d": gzip.compress(record), "e.warc.gz": gzip.compress(record * 2)}).collect()
    whole = Counter(r["path"] for r in rows if r["reason"] is None)
    assert whole == {"a.warc": 1, "b": 2, "d": 1} and {r["target_uri"] for r in rows if r["reason"] is None} == {"http://a b"}
    assert [r["reason"] for r in rows if r["path"] == "e.warc.gz"] == ["wrong length"]
    assert [r["reason"] for r in read_all(spark, {"a.warc": record, "d": gzip.compress(record)}, max_record_bytes=4).collect()] == ["too large"] * 2
    assert read_all(spark, {}).count() == 0


# --- clusters ----------------------------------------------------------------------


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in v)]
    hashed = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (*hashed(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for done in range(rounds + 1):
        of = [min(range(len(centroids)), key=lambda j: (square(v, centroids[j]), j)) for _, v in kept]
        if done < rounds:
            for j in range(len(centroids)):
                if own := [v for (_, v), c in zip(kept, of, strict=True) if c == j]:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    far = [square(v, centroids[c]) for (_, v), c in zip(kept, of, strict=True)]
    by = Counter()
    for c, d in zip(of, far, strict=True):
        by[c] += d
    return [(i, c, d, by[c], sum(far), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), c, d in zip(kept, of, far, strict=True)]


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_clusters_equal_brute_force(spark, rounds):
    draw = random.Random(4)
    point = lambda far: [draw.gauss(far, 0.3) for _ in range(64)]
    rows = [(i, point(i % 5)) for i in range(150)] + [(1000 + i, [0.25] * 64) for i in range(80)]
    rows += [(2000, None), (2001, [0.1] * 63), (2002, [None] + [0.1] * 63), (2003, [float("nan")] * 64), (2004, [float("inf")] + [0.0] * 63), (2005, [-131071.5] + [131071.25] * 63)]
    rows += [(7, point(3)), (7, point(3)), (None, point(2)), (8, []), (2006, [1e300] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("dots", F.lit(1)).withColumn("cluster", F.lit(1)).repartition(6)
    got = clusters(df, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_clusters(rows, 8, rounds), key=repr)


def test_clusters_of_few_equal_and_no_vectors(spark):
    rows = [(i, [0.0] * 64) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, clusters(df).collect())) == sorted(brute_clusters(rows, 8, 10))
    assert clusters(df.limit(0)).count() == 0 and whole_vectors(df, dims=5).count() == 0


# --- hot keys ----------------------------------------------------------------------


def test_hot_keys_are_split(spark):
    """Two thirds of the rows have one key: adaptive execution splits it, and results are those of a plain join."""
    from tidewater.llm.shared import with_groups

    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 300_000, 1, 8).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 1000).alias("key"), F.xxhash64("id").alias("v"))
        joined = with_groups(rows, ["key"], F.min("v").alias("least"), F.count("*").alias("n"), name="hot", having="n > 1")
        run = joined._jdf.queryExecution()
        assert run.toRdd().count() == 300_000 and "skew=true" in run.executedPlan().toString()
        assert joined.filter("v < least").count() == 0 and joined.filter("key = 7").select("n").distinct().count() == 1
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
