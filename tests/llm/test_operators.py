"""Each operator against a brute-force version, on real rows with edge cases added."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import chat, language_id, queries, substring_dedup, tokens, toxicity
from tidewater.llm.decontamination import banded_distance, contaminated
from tidewater.llm.graph import components
from tidewater.llm.line_dedup import dedup_lines
from tidewater.llm.ngram_join import similar_documents
from tidewater.llm.packing import pack, sequences
from tidewater.llm.quality import quality
from tidewater.llm.shared import SLICE_BYTES, word_hashes
from tidewater.llm.substring_dedup import remove_repeated
from tidewater.llm.token_counts import token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{k % 701}" for k in range(30_000))
EDGES = [
    (9001, None),
    (9002, ""),
    (9003, " \t\n\x0b\x0c\r "),
    (9004, "one two"),
    (9005, "One TWO"),
    (9006, LONG),
    (9007, "nbsp\xa0joined   wide <|endoftext|> it's\n\n 'll \x85 x漢字🙂"),
    (9008, "The same line with more than eight words in it here.\nThe same line with more than nine words in it here.\nThe same line with more than eight words in it, here.\nshort a\nSHORT  A"),
]


@pytest.fixture(scope="module")
def rows(spark):
    got = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in got] + EDGES


@pytest.fixture(scope="module")
def docs(spark, rows):
    """All rows, with columns that clash with names used inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("n", "key", "words", "line", "node", "packed", "tag", "gone", "known", "length", "score", "quality_", "row", "at", "_doc_id", "item_id", "start"):
        df = df.withColumn(name, F.lit("x"))
    return df.cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_counts(docs, empty):
    for r in quality(docs).select("text", "quality.*").collect():
        w, t = words_of(r.text), r.text or ""
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = defaultdict(int)
        for g in grams:
            count[g] += 1
        again = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
        said = [x for x in t.split("\n") if words_of(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(said) - len(set(said)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r.kept and r.base_failed)
    assert quality(empty).count() == 0


@pytest.mark.parametrize(("line", "ok"), [("A clean line, with an end.", True), ("no end at all", False), ("a | b | c | d.", False), ("x# y$ z% a& b.", False), ("Licensed under the MIT License.", False), ("NO!! WAY!! AT!! ALL!!", False), ("", True)])
def test_quality_lines(spark, line, ok):
    text = line + "\n" + "This clean sentence has quite enough different words to be kept here anyway."
    r = quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("quality.*").first()
    assert r.n_failed_lines == (0 if ok else 1) and r.kept and (line in r.cleaned.split("\n")) == ok


def removed(rows, width):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w = words_of(text)
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if g in seen:
                keep[k : k + width] = [False] * width
            seen.add(g)
        out[doc] = " ".join(x for x, y in zip(w, keep, strict=True) if y)
    return out


def test_substring_dedup(docs, empty, rows):
    expected = removed(rows, 20)
    got = remove_repeated(docs).collect()
    assert len(got) == len(rows)
    assert all((r.text or "") == expected[r.doc_id] and (r.text is None) == (r.doc_id == 9001) for r in got)
    assert remove_repeated(empty).count() == 0


def test_substring_dedup_of_repeated_rows_and_null_ids(spark):
    run = " ".join(f"v{k}" for k in range(25))
    df = spark.createDataFrame([(5, run), (5, run), (None, run + " z"), (7, "a " + run)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeated(df).collect())
    assert got == [(0, 0), (5, 25), (5, 25), (7, 25)]


@pytest.mark.parametrize("window", [2, 3, 9, 20, 25])
def test_substring_dedup_of_any_window_and_a_passage_in_many_documents(spark, window):
    rng = random.Random(14)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for d in range(400):
        own = [f"v{rng.randint(0, 5000)}" for _ in range(rng.randint(0, 30))]
        a, z = rng.choice([(0, 40), (0, 40), (0, 25), (7, 40), (5, 33)])
        at = rng.randint(0, len(own))
        rows.append((d, " ".join(own[:at] + passage[a:z] + own[at:])))
    rows += [(1000, " ".join(passage[:20] + ["fork"] + passage[:20] + ["fork"] + passage[20:])), (1001, " ".join(["a"] * 60))]
    expected = removed(rows, window)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in remove_repeated(df, window=window).collect()} == expected


def test_substring_dedup_refuses_other_ids(spark):
    with pytest.raises(ValueError, match="integers"):
        remove_repeated(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def _long_rows(n):
    """Rows of 700 words each, of few distinct ones; passages are shared, also by rows far from each other."""
    rng = random.Random(15)
    words = [f"word{k:03}" for k in range(500)]
    passages = [rng.choices(words, k=60) for _ in range(40)]
    return [(d, " ".join(rng.choices(words, k=320) + passages[d % 37] + rng.choices(words, k=320))) for d in range(n)]


def test_substring_dedup_of_a_batch_of_several_slices(spark):
    rows = _long_rows(900)
    rows[7] = (7, " ".join(f"{t} {t[:700]}" for _, t in rows[100:500]))  # longer than a slice
    rows[8], rows[9] = (8, None), (9, "")
    assert sum(len(t or "") for _, t in rows) > 3 * SLICE_BYTES and len(rows[7][1]) > SLICE_BYTES
    expected = removed(rows, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.text or "" for r in remove_repeated(df).collect()} == expected


def test_substring_dedup_needs_no_more_memory_for_a_larger_batch(spark):
    """What tasks hold in Python objects and numpy arrays doesn't grow with the rows of a batch."""

    class Steps:
        schema = spark.createDataFrame([], "doc_id long").schema

        def mapInArrow(self, step, schema):
            return step

    asked, packed, edges = substring_dedup._asked(Steps(), 20), substring_dedup._packed(Steps()), substring_dedup._edges(Steps(), 20)

    def peak(step, batch):
        tracemalloc.start()
        n = sum(out.num_rows for out in step([batch]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n
        return most

    most = defaultdict(list)
    for n in (800, 800, 2400):  # the first fills the cache of words
        ids, texts = zip(*_long_rows(n), strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["doc_id", "text"])
        frames = pa.Table.from_batches(list(packed([batch]))).combine_chunks()["packed"].chunk(0)
        kind = pa.list_(pa.struct([("key", pa.int64()), ("settled", pa.bool_())]))
        every = [[{"key": int(h), "settled": False} for h in np.unique(substring_dedup._anchors(word_hashes(t.encode().split()), 20)[1]).view(np.int64)] for t in texts]
        found = pa.RecordBatch.from_arrays([pa.array(ids), frames, pa.array(every, kind)], ["doc_id", "packed", "known"])
        for name, step, given in (("asked", asked, batch), ("packed", packed, batch), ("edges", edges, found)):
            most[name].append(peak(step, given))
    assert all(large < 1.5 * small for _, small, large in most.values()), dict(most)


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<turn|", "</turn>", "\\", "\\b", "\\l", ">", "|", "\n", "é", "word " * 30, "n|user>"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", None, "a>b"]) if t else rng.choice(["system", "user"]), rng.choice([None, "", "".join(rng.choices(bits, k=6))])) for c in [*range(30), None] for t in range(rng.randint(1, 9))]
    rows += [(1, 0, "user", "tie"), (1, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn("tokens", F.lit(1))
    expected = defaultdict(list)
    first = lambda x: (x is not None, x)
    for c, t, role, text in sorted(rows, key=lambda r: (first(r[0]), r[1], r[2] or "", r[3] or "")):
        expected[c].append((role or "", text or ""))
    for stretch in (64, 1):
        windows = chat.format_windows(df, budget=120, history=40, stretch_budgets=stretch).cache()
        got, loss, spans = defaultdict(list), defaultdict(str), windows.orderBy("conv_id", "window").collect()
        for r in chat.read_back(windows).orderBy("conv_id", "window").collect():
            got[r.conv_id] += [(t.role, t.text) for t in r.turns]
            loss[r.conv_id] += r.loss_text
        assert got == expected
        assert all(loss[c] == "".join(t for role, t in turns if role == "assistant") for c, turns in expected.items())
        assert any(r.text.count("<turn|") > 1 and "<turn|h|" in r.text for r in spans) and any("<turn|s|system>" in r.text for r in spans)
        assert {(r.conv_id, r.window): (r.text, r.n_tokens) for r in spans} == windowed(expected, 120, 40, stretch * 120)
        assert all(len(r.text.encode()) <= 4 * r.n_tokens and (r.n_tokens <= 120 or r.text.count("<turn|n|") == 1) for r in spans)
    assert chat.format_windows(df.limit(0)).count() == 0


def windowed(conversations, budget, history, stretch):
    """(conversation, tokens before) -> (text, tokens) of each window, turn by turn."""
    esc = lambda x: x.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")
    out = {}
    for c, turns in conversations.items():
        said = [lambda kind, r=r, t=t: f"<turn|{kind}|{esc(r)}>{esc(t)}</turn>" for r, t in turns]
        size = [-(-len(f("n").encode()) // 4) for f in said]
        before = [sum(size[:k]) for k in range(len(turns))]
        system = turns[0][0] == "system"
        room = max(1, budget - history - (size[0] if system else 0))
        starts = [0]
        for k in range(1, len(turns)):
            if before[k] + size[k] - before[starts[-1]] > room or before[k] // stretch > before[starts[-1]] // stretch:
                starts.append(k)
        for a, z in zip(starts, [*starts[1:], len(turns)], strict=True):
            again = [k for k in range(1 if system else 0, a) if before[a] - before[k] <= history]
            parts = ([(0, "s")] if system and a else []) + [(k, "h") for k in again] + [(k, "n") for k in range(a, z)]
            out[c, before[a]] = "".join(said[k](kind) for k, kind in parts), sum(size[k] for k, _ in parts)
    return out


def test_chat_of_long_turns_and_a_long_conversation(spark):
    """A turn of many stretches, and a conversation of thousands of turns over several blocks of turn numbers, some turns with one number."""
    rng = random.Random(3)
    rows = [(1, 0, "system", "be short"), (1, 1, "user", "<" * 1400), (1, 2, "assistant", "z" * 20_000), (1, 3, "user", "x")]
    rows += [(2, k // 2, rng.choice(["user", "assistant"]), f"{k} " + "w " * rng.randint(0, 40)) for k in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    windows = chat.format_windows(df, budget=100, history=30, stretch_budgets=8)
    expected = {c: [(r, t) for _, _, r, t in sorted(x for x in rows if x[0] == c)] for c in (1, 2)}
    assert {(r.conv_id, r.window): (r.text, r.n_tokens) for r in windows.collect()} == windowed(expected, 100, 30, 800)
    given = chat.format_windows(df.withColumn("count", F.lit(40)), budget=100, history=0, tokens_col="count")
    assert {r.n_tokens for r in given.filter("conv_id = 2").collect()} == {80}


def test_registered_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        got = [tuple(r) for r in queries.queries()[name](spark, SF).select(columns).collect()]
        assert sorted(got, key=repr) == sorted(found.fetchall(), key=repr), name


def edits(item, text):
    """Least edits of item against any stretch of text, over the whole table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_distance():
    rng = random.Random(4)
    for _ in range(200):
        item = [rng.randint(0, 3) for _ in range(rng.randint(1, 12))]
        text = [rng.randint(0, 3) for _ in range(rng.randint(1, 20))]
        got, a, z = banded_distance(np.array(item), np.array(text), -len(item), len(text))
        assert got == edits(item, text) and edits(item, text[a:z]) == got


def test_decontamination(spark, docs, empty):
    rng = random.Random(5)
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    planted = []
    for k, item in enumerate(bench):
        text = list(item.upper() if k % 3 == 0 else item)
        for _ in range(int(0.06 * len(item)) if k % 2 else int(0.3 * len(item))):
            at = rng.randrange(len(text))
            text[at] = rng.choice(["", "x", text[at] + "y"])
        planted.append((k, rng.choice(["", "before "]) + "".join(text) + rng.choice(["", " after"])))
    items = spark.createDataFrame([*enumerate(bench), (90, None), (91, ""), (92, "tiny one"), (93, "x=1")], "item_id int, text string")
    df = spark.createDataFrame([*planted, (50, "a tiny  one, a Tiny ONE here"), (51, None), (52, "so x=1 it is"), (53, "x" * 200_000)], "doc_id long, text string").withColumn("item_id", F.lit("x"))
    fold = lambda t: re.sub(r"\s", " ", t).lower()
    for size in (1_000_000, 300):
        got = {(r.doc_id, r.item_id): r for r in contaminated(df, items, block_chars=size).collect()}
        for d, text in planted:
            for i, item in enumerate(bench):
                near = edits(fold(item), fold(text))
                if near <= min(int(0.1 * len(item)), (len(item) - 7) // 7):
                    r = got[d, i]
                    assert r.edits == near == edits(fold(item), fold(text[r.start : r.end]))
                elif d != i:
                    assert (d, i) not in got
        assert {(50, 92), (52, 93)} <= set(got) and not [k for k in got if k[0] in (51, 53) or k[1] in (90, 91)]
    assert contaminated(empty, items).count() == 0 and contaminated(df, items.limit(0)).count() == 0


def test_decontamination_of_repeated_rows_and_ids_of_one_name(spark):
    item = "which of these four answers is the right one for this question?"
    df = spark.createDataFrame([(1, item), (1, item), (None, "so: " + item.upper())], "id long, text string")
    items = spark.createDataFrame([("a", item), ("b", item)], "id string, text string")
    got = contaminated(df, items, id_col="id", item_col="id")
    assert sorted((r.id or 0, r.benchmark_id, r.start, r.edits) for r in got.collect()) == [(0, "a", 4, 0), (0, "b", 4, 0), (1, "a", 0, 0), (1, "a", 0, 0), (1, "b", 0, 0), (1, "b", 0, 0)]


@pytest.mark.parametrize("size", range(7, 30))
def test_decontamination_budget_of_short_items(spark, size):
    """By the formula: a tenth of the characters, and no more than leaves one of the q-grams untouched; edits that spoil as much as they can."""
    from tidewater.llm.chars import runs
    from tidewater.llm.decontamination import _block, _matches

    item = "".join(chr(97 + k) for k in range(size)) if size < 26 else "".join(chr(97 + k % 26) for k in range(size))
    budget = min(size // 10, (size - 7) // 7)
    for n in (budget, budget + 1):
        text = list(item)
        for k in range(n):
            text[(k + 1) * size // (n + 1)] = "#"
        found = list(_matches(next(runs(["zz " + "".join(text) + " zz"])), _block([(1, item)], 0.1, 7)))
        assert bool(found) == (n <= budget), (size, n)


def test_decontamination_of_swapped_words_and_partial_passages(spark):
    rng = random.Random(12)
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text"), "item_id").collect()]
    short, items = bench[0], [t for t in bench if len(t) >= 144]
    at = next(m.start() for m in re.finditer(r"\w{7,}", short) if m.start() > 20)
    swapped = short[:at] + "zzzzzzz" + short[at + 7 :]
    rows, wanted = [(0, "before " + swapped + " after")], {0: short}
    for k, item in enumerate(items[:8], 1):
        half = -(-len(item) // 2)
        at = rng.choice([0, len(item) - half, rng.randrange(len(item) - half)])
        rows.append((k, "what comes first: " + item[at : at + half] + " and what follows"))
        wanted[k] = item
    rows.append((99, " ".join(f"q{k}x" for k in range(300))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = contaminated(df, spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")).collect()
    assert {(r.doc_id, bench[r.item_id]) for r in got} == set(wanted.items())
    fold = lambda t: re.sub(r"\s", " ", t).lower()
    text = dict(rows)
    for r in got:
        assert edits(fold(text[r.doc_id][r.start : r.end]), fold(bench[r.item_id])) == r.edits or r.doc_id == 0


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 8:
        return a == b
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def test_line_dedup(spark, docs, empty, rows):
    some = [r for r in rows if r[0] >= 9000 and r[0] != 9006 or r[0] < 60]
    lines = [(d, k, re.split(r"[\x20\x09-\x0D]+", x.lower().strip(" \t\x0b\x0c\r"))) for d, t in some for k, x in enumerate((t or "").split("\n")) if words_of(x)]
    lines.sort()
    gone = {(d, k) for n, (d, k, w) in enumerate(lines) if any(one_edit(w, v) for _, _, v in lines[:n])}
    expected = {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in some}
    got = dedup_lines(docs.filter(F.col("doc_id").isin([d for d, _ in some])))
    assert got.columns == [*docs.columns, "line_dedup"]
    assert {r.doc_id: r.text for r in got.collect()} == expected
    assert got.agg(F.sum("line_dedup.n_near")).first()[0] > 0
    assert dedup_lines(empty).count() == 0


def near_lines(rows, units, least):
    """(id, line number) of the lines that go, by comparing every two."""
    plain = [(d, k, re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")) for d, t in rows for k, x in enumerate((t or "").split("\n")) if words_of(x)]
    plain = [(d, k, units(x)) for d, k, x in sorted(plain, key=lambda r: r[:2])]
    return {(d, k) for n, (d, k, a) in enumerate(plain) for _, _, b in plain[:n] if a == b or (min(len(a), len(b)) >= least and word_edits(a, b) <= 1)}


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_lines_with_several_edits(spark):
    """Lines of 10 to 90 words with up to one edit in ten of them, and more; a passage in many lines, hot parts, equal lines, a very long one."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(5000)]
    lines = []
    for _ in range(90):
        base = rng.choices(words, k=rng.randint(10, 90))
        for edits in (0, 0, len(base) // 10, len(base) // 10, len(base) // 20 + 1, len(base) // 6):
            w = list(base)
            for _ in range(edits):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], rng.choices(words, k=1), [w[at], rng.choice(words)]])
            lines.append(" ".join(w))
    passage = rng.choices(words, k=30)
    lines += [" ".join([*rng.choices(words, k=rng.randint(5, 40)), *passage, *rng.choices(words, k=rng.randint(5, 40))]) for _ in range(60)]
    lines += [" ".join(rng.choices(words, k=20_000))]
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[k * 10 : k * 10 + 10])) for k in range(-(-len(lines) // 10))] + [(-1, None), (-2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("earlier", F.lit("x"))
    got = {r.doc_id: r.text for r in dedup_lines(df, edits_in=10).collect()}
    places = sorted((d, k, x.split()) for d, t in rows for k, x in enumerate((t or "").split("\n")) if x)
    near = {(d, k) for n, (d, k, a) in enumerate(places) if any(one_edit(a, b) or some_edits(a, b, 10) for _, _, b in places[:n])}
    left = Counter((d, x) for d, t in got.items() for x in (t or "").split("\n"))
    kept = {(d, k) for d, k, a in places if left[d, " ".join(a)]}
    # nothing goes that is not near an earlier line; of those that are, few stay
    assert len({(d, k) for d, k, _ in places} - kept - near) == 0 and len(near & kept) <= 0.1 * len(near) and len(near) > 250
    assert got[-1] is None and got[-2] == "" and dedup_lines(df.limit(0), edits_in=10).count() == 0
    with pytest.raises(ValueError, match="words"):
        dedup_lines(df, unit="char", edits_in=10)


@pytest.mark.parametrize(("unit", "least"), [("word", 8), ("word", 2), ("char", 8), ("char", 5)])
def test_line_dedup_units(spark, unit, least):
    """Lines of 1 to 34 units, around powers of two too, with none to two edits anywhere; some repeated, one variant in many lines."""
    rng, lines = random.Random(11), []
    letters = [chr(0x4E00 + k) for k in range(60)] if unit == "char" else [f"w{k}" for k in range(60)]
    gap = "" if unit == "char" else " "
    for n in (1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 31, 32, 33, 34):
        base = rng.choices(letters, k=n)
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w)) if w else 0
                w[at : at + 1] = rng.choice([[], rng.choices(letters, k=1), [*w[at : at + 1], rng.choice(letters)]])
            lines.append(gap.join(w))
    lines += [gap.join([*letters[:9], str(k) if unit == "word" else chr(0x3400 + k), *letters[9:15]]) for k in range(40)]
    rng.shuffle(lines)
    rows = [(d, "\n".join(lines[d * 5 : d * 5 + 5])) for d in range(-(-len(lines) // 5))]
    gone = near_lines(rows, list if unit == "char" else str.split, least)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dedup_lines(df, unit=unit, units_per_edit=least)
    assert {r.doc_id: r.text for r in got.collect()} == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}
    counts = got.agg(F.sum("line_dedup.n_repeated") + F.sum("line_dedup.n_near"), F.sum("line_dedup.n_near")).first()
    assert counts[0] == len(gone) and counts[1] > 20


def test_line_dedup_of_clashing_columns_repeated_rows_and_null_ids(spark):
    line = "one line of more than eight words is here"
    names = ["_doc_id", "tag", "at", "row", "first", "line_no", "left", "line_dedup", "_tag", "a.b"]
    rows = [(2, line), (2, line), (None, line), (7, line + " x\n\n " + line.upper()), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(n) for n in names])
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", *[n for n in names if n != "line_dedup"], "line_dedup"]
    found = sorted(((r.doc_id or 0, r.text, tuple(r.line_dedup)) for r in got.collect()), key=repr)
    assert found == sorted([(0, line, (1, 0, 0)), (2, "", (1, 1, 0)), (2, "", (1, 1, 0)), (7, "", (3, 1, 1)), (8, None, (0, 0, 0)), (9, "", (1, 0, 0))], key=repr)


def test_line_dedup_of_a_very_long_line(spark):
    words = [f"w{k}" for k in range(30_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:20_000], "x", *words[20_001:]])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert {r.doc_id: r.text == "" for r in dedup_lines(df).collect()} == {1: False, 2: True, 3: False}


def test_token_counts(docs, empty, rows):
    tok = Tokenizer.from_file(PATH)
    expected = {d: len(tok.encode(t or "", add_special_tokens=False).ids) for d, t in rows}
    got = token_counts(docs, PATH).collect()
    assert {r.doc_id: r.n_tokens for r in got} == expected and len(got) == len(rows)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and token_counts(empty, PATH).count() == 0


TWICE = [(1, "one text, twice"), (1, "one text, twice"), (1, "another é漢🙂"), (None, "no id"), (None, "no id"), (None, None), (2, "")]


def test_token_counts_of_null_ids_and_repeated_rows(spark):
    tok = Tokenizer.from_file(PATH)
    expected = [(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in TWICE]
    got = token_counts(spark.createDataFrame(TWICE, "doc_id long, text string"), PATH).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(expected)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_on_any_text(name):
    path = public_tokenizers.path(name)
    tok, enc, rng = Tokenizer.from_file(path), tokens.Encoder(path, len, tokens.vocabulary_pieces(path)), random.Random(6)
    assert tokens.in_pieces(path) == name.startswith("byte")
    bits = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "1", "٣", "<|endoftext|>", "\x85", "\xa0", " ", "\x1c", ".", "!?", "漢字", "🙂", "é", "​", "\r\n", "don't"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 12)))
        assert sum(enc.parts(text)) == len(tok.encode(text, add_special_tokens=False).ids), repr(text)


def test_packing(docs, empty, rows):
    tok = Tokenizer.from_file(PATH)
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    pieces = pack(docs, PATH).collect()
    at, filled = defaultdict(int), defaultdict(int)
    for p in sorted(pieces, key=lambda p: p.start):
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.start == at[p.doc_id] and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        at[p.doc_id] += p.length
    assert at == {d: len(x) for d, x in ids.items()}
    for p in sorted(pieces, key=lambda p: p.offset):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 1024
    total = sum(filled.values())
    assert sum(r.padded_length for r in sequences(pack(docs, PATH)).collect()) < 1.1 * total
    assert pack(empty, PATH).count() == 0


def test_packing_of_null_ids_and_repeated_rows(spark):
    tok = Tokenizer.from_file(PATH)
    rows = [*TWICE, (None, LONG), (3, LONG), (3, LONG)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    # each row's ids lie in pieces of its own: as many of each id and length start at 0, and all together as many ids
    ids = [(d, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows]
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == Counter((d, len(x)) for d, x in ids)
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in ids)
    for p in pieces:
        crcs = [zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) for d, x in ids if (d, len(x)) == (p.doc_id, p.doc_tokens)]
        assert p.ids_crc32 in crcs
    filled = defaultdict(int)
    for p in sorted(pieces, key=lambda p: p.offset):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 1024


def shingles(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def joined(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_ngram_join(docs, empty, rows):
    got = similar_documents(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == joined(rows) and len(got) == len(rows)
    assert similar_documents(empty).count() == 0


def test_ngram_join_of_a_large_group(spark):
    rng = random.Random(7)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice([f"x{rng.randint(0, 3)}", f"y{d}"])
        rows.append((d, " ".join(w)))
    rows += [(900 + k, " ".join([*base[:20], *(f"z{k}_{j}" for j in range(rng.randint(0, 60)))])) for k in range(20)]
    df, expected = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache(), joined(rows)
    for options in ({}, {"small": 1}, {"small": 10**9, "pivots": 2}, {"cell_bits": 1, "pivots": 0, "small": 5}):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(df, **options).collect()} == expected, options


def test_ngram_join_of_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (8, text.upper()), (9, "other")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in similar_documents(df).collect()) == [(0, None), (3, 3), (3, 3), (8, 3), (9, 9)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    edges = spark.createDataFrame([*chain, (100, 101), (5, 5), (101, 100), (None, 3)], "u long, v long")
    got = dict(components(edges).collect())
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_language_id(spark):
    r = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(queries.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in r if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in r)
    assert sum(x.lang == x.lang_pred for x in held) >= 0.97 * len(held)


def test_language_id_edges(spark, docs, empty):
    model = language_id.fit(docs.filter("doc_id < 9000").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")))
    got = {x.doc_id: x.lang_pred for x in language_id.predict(docs, model).collect()}
    assert got[9001] == got[9002] == got[9003] == "und" and len(got) == docs.count()
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(empty.withColumn("lang", F.lit("a")))
    assert {x.lang_pred for x in language_id.predict(docs, nothing).collect()} == {"und"}
    code = language_id.codewords(9)
    assert min(int((a != b).sum()) for a, b in combinations(code, 2)) >= 6


def test_toxicity(spark, empty):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = queries.op10_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [x.score for x in r if x.toxic == 0], [x.score for x in r if x.toxic == 1]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))
    assert auc > 0.97 and sum(x.predicted == x.toxic for x in r) > 0.95 * len(r)
    assert sum(x.predicted for x in r if x.toxic == 1) >= 0.9 * len(bad) and sum(x.predicted for x in r if x.toxic == 0) <= 10
    model = toxicity.fit(labels.limit(0), docs=empty)
    scored = toxicity.score(spark.createDataFrame(EDGES, "doc_id long, text string"), model).collect()
    assert len(scored) == len(EDGES) and all(0 <= x.score <= 1 and not math.isnan(x.score) for x in scored)
    assert toxicity.score(empty, model).count() == 0


def ngrams(text, n):
    """Folded n-grams of a text, at all places."""
    plain = "".join(" " if c.isspace() else c.lower() if len(c.lower()) == 1 and ord(c) < 0x10000 else c for c in text or "")
    return [plain[k : k + n] for k in range(len(plain) - n + 1)]


def cell_of(gram, seed, bits):
    from tidewater.llm.chars import runs

    return int(next(runs([gram])).grams(len(gram), seed=seed)[0][0] >> np.uint64(64 - bits))


@pytest.fixture(scope="module")
def some(rows):
    """Short rows and all edge cases but the longest, for brute force over characters."""
    return [(d, t) for d, t in rows if d >= 9000 and d != 9006 or len(t or "") < 900][:90]


def test_toxicity_against_plain_python(spark, some):
    bits, orders = 12, (3, 4)
    labelled = [(d, int(d % 3 == 0)) for d, _ in some if d % 5] + [(None, 1), (some[0][0], 7)]
    df = spark.createDataFrame(some, "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("toxic", F.lit(3))
    model = toxicity.fit(spark.createDataFrame(labelled, "doc_id long, toxic int"), docs=df, orders=orders, bits=bits, prior=2.0, decay=1e-2)
    # rows labelled 7 teach nothing; the id that has both counts by the other one
    known, label = {}, {d: y for d, y in labelled if y in (0, 1)}
    cells = {d: {known.setdefault(g, cell_of(g, len(g), bits)) for n in orders for g in ngrams(t, n)} for d, t in some}
    z = {d: sum(float(model.weight[c]) for c in cs) + model.bias for d, cs in cells.items()}
    got = toxicity.score(df.unionByName(df.limit(1)), model).collect()
    assert len(got) == len(some) + 1
    for r in got:
        assert abs(r.score - 1 / (1 + math.exp(-z[r.doc_id]))) < 1e-4 and r.predicted == (r.score >= 0.5)
    # each fold's regression is over the others, and the model their mean
    rows = [(cells[d], label[d]) for d, t in some if label.get(d) in (0, 1) and t is not None]
    packed = [np.diff(np.array(sorted(c)), prepend=0).astype("<u4").tobytes() for c, _ in rows]
    texts = spark.createDataFrame([(label[d], t) for d, t in some if label.get(d) in (0, 1) and t is not None], "label int, text string")
    table = toxicity._listed(texts, orders, bits, 3).cache()
    fitted, held = [], []
    for k in range(3):
        weight, bias = toxicity.regression(table.filter(f"fold <> {k}"), bits=bits, prior=2.0, decay=1e-2, steps=25)
        fitted.append((weight, bias))
        learned = [r for r, p in zip(rows, packed, strict=True) if zlib.crc32(p) % 3 != k]
        held += [(y, float(weight[list(cs)].sum(dtype=float)) + bias) for (cs, y), p in zip(rows, packed, strict=True) if zlib.crc32(p) % 3 == k]
        optimal(weight, bias, learned, bits)
    assert np.array_equal(model.weight, (sum(w.astype(float) for w, _ in fitted) / 3).astype(np.float32))
    # no middle parts the held rows much better than the one chosen
    middle = sum(b for _, b in fitted) / 3 - model.bias

    def f1(at):
        hits = sum(y for y, z in held if z >= at)
        return 2 * hits / max(sum(z >= at for _, z in held) + sum(y for y, _ in held), 1)

    assert f1(middle - 1e-9) >= max(f1(z - 1e-9) for _, z in held) - 0.0101


def optimal(weight, bias, learned, bits):
    """The loss of the rows learned from can hardly be lowered along any cell."""
    counts, n = np.zeros((2, 1 << bits)), np.zeros(2)
    for cs, y in learned:
        counts[y, list(cs)] += 1
        n[y] += 1
    ratio = toxicity.log_count_ratios(counts, n, 2.0)
    share = [(counts[k] + 2 * n[k] / n.sum()) / (n[k] + 2 * n[k] / n.sum()) for k in (0, 1)]
    assert np.allclose(ratio, np.log(share[1]) - np.log(share[0]))
    w = np.divide(weight, ratio, out=np.zeros(1 << bits), where=np.abs(ratio) > 1e-9)

    def gradient(w, b):
        g = 1e-2 * w
        for cs, y in learned:
            c = list(cs)
            p = 1 / (1 + math.exp(-float((w[c] * ratio[c]).sum()) - b))
            g[c] += (p - y) * 0.5 / n[y] * ratio[c]
        return np.abs(g).max()

    assert gradient(w, bias) < 0.02 * gradient(np.zeros_like(w), 0.0)


def test_toxicity_does_not_depend_on_partitions(spark, some):
    df = spark.createDataFrame([x for x in some if x[0] is not None], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d, _ in some], "doc_id long, toxic int")
    a, b = (toxicity.fit(labels, docs=df.repartition(n), bits=12) for n in (1, 5))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_toxicity_unpacks_a_batch_in_slices():
    import tracemalloc

    import pyarrow as pa
    import zstandard

    cells, n = np.arange(0, 40_000, 2), 1000
    packed = zstandard.ZstdCompressor(level=1).compress(np.diff(cells, prepend=0).astype("<u4").tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([packed] * n, pa.binary())], ["label", "fold", "cells"])

    class OneTask:
        """A table whose only task runs here, so that its memory is seen."""

        def coalesce(self, _):
            return self

        def mapInArrow(self, task, _):
            self.done = pa.Table.from_batches(list(task(iter([batch]))))
            return self

        def toArrow(self):
            return self.done

    tracemalloc.start()
    assert toxicity.regression(OneTask(), bits=16, prior=2.0, decay=1e-2, steps=1) is None
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all cells of the batch at once take 160 MB
    assert peak < 60e6

    def add(total, label, cells, sizes):
        total[:] += len(label), label.sum(), len(cells), cells.sum(), sizes.sum()

    got = toxicity._summed(OneTask(), add, 5, "<i8")
    assert got.tolist() == [n, n, n * len(cells), n * cells.sum(), n * len(cells)]


def test_toxicity_refuses_two_folds(spark, empty):
    with pytest.raises(ValueError, match="folds"):
        toxicity.fit(spark.createDataFrame([], "doc_id long, toxic int"), docs=empty, folds=2)


def test_toxicity_of_one_label_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None), (None, "other")], "doc_id long, text string")
    for labels, predicted in (([(1, 0)], 0), ([(1, 1)], 1), ([(2, 1), (1, 0)], 0), ([(1, 5)], 0)):
        model = toxicity.fit(spark.createDataFrame(labels, "doc_id long, toxic int"), docs=docs, bits=10)
        assert [r.predicted for r in toxicity.score(docs, model).collect()] == [predicted] * 3


def test_quasi_newton_finds_a_minimum():
    rng = np.random.default_rng(13)
    a = rng.normal(size=(40, 40))
    a, b = a @ a.T + np.eye(40), rng.normal(size=40)
    w = toxicity.minimized(lambda w: (float(0.5 * w @ a @ w - b @ w), a @ w - b), np.zeros(40), steps=400, enough=1e-8)
    assert np.allclose(a @ w, b, atol=1e-4)


def test_language_id_against_plain_python(spark, some):
    df = spark.createDataFrame([*some, (9100, "\u00bd \u2460 \u2167 42_"), (None, "the end")], "doc_id long, text string")
    df = df.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.element_at(F.array(*map(F.lit, "abc")), (F.col("doc_id") % 3 + 1).cast("int"))))
    all_rows, cells = df.collect(), 2**10
    model = language_id.fit(df, cells=cells, rows_per_language=10**9)
    known, counts = {}, np.zeros((3, cells))
    of = {t: [known.setdefault(g, cell_of(g, 0, 10)) for g in ngrams(t, 3)] for _, t, _ in all_rows}
    for _, t, lang in all_rows:
        if lang and t:
            np.add.at(counts["abc".index(lang)], of[t], 1)
    p = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)
    code = language_id.codewords(3)
    weights = [np.log(p[bit == 1].mean(axis=0)) - np.log(p[bit == -1].mean(axis=0)) for bit in code.T]
    margin = np.array([[code[k, b] * (p[k] * weights[b]).sum() for b in range(code.shape[1])] for k in range(3)])
    scale = np.maximum(margin.mean(axis=0), 1e-6)
    trust = np.clip(margin.min(axis=0) / scale, 0.05, 1)
    got = language_id.predict(df, model).collect()
    assert len(got) == len(all_rows)
    by_id = {r.doc_id: r for r in got}
    for d, t, _ in all_rows:
        r = by_id[d]
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, False)
            continue
        said = [np.mean([w[c] for c in of[t]]) if of[t] else 0.0 for w in weights]
        loss = [sum(trust[b] / trust.sum() * math.log1p(math.exp(-code[k, b] * 4 * said[b] / scale[b])) for b in range(len(said))) for k in range(3)]
        share = np.exp(4 * (min(loss) - np.array(loss)))
        share /= share.sum()
        assert r.lang_pred == "abc"[int(share.argmax())] and abs(r.score - share.max()) < 1e-4
        assert r.ambiguous == (2 * share.max() + share.min() - 1 < 0.2) or abs(2 * share.max() + share.min() - 1.2) < 1e-3


def quality_by_hand(text):
    """The text of the lines that pass, or None where the document is rejected."""
    import regex

    from tidewater.llm import quality as q

    w = words_of(text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count = Counter(grams)
    again = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    if len(w) < 10 or 100 * len(again) > 20 * len(w):
        return None
    has = lambda pattern, x: regex.search("(?i)" + pattern.replace(r"\z", r"\Z"), x) is not None

    def passes(x):
        n = len(words_of(x))
        bars = sum(1 for _ in re.finditer(q.SEPARATOR, x))
        ok = has(q.SENTENCE_END, x) and 5 * len(re.findall(q.SYMBOL, x)) <= n and 10 * len(re.findall(q.SHOUT, x)) <= 3 * n
        return not n or ok and not (bars >= 3 and 5 * bars >= n) and not (n <= 10 and has(q.phrase_pattern(q.NAVIGATION_PHRASES), x)) and not has(q.phrase_pattern(q.BOILERPLATE_PHRASES), x)

    kept = [x for x in text.split("\n") if passes(x)]
    return "\n".join(kept) if 2 * sum(map(len, words_of(" ".join(kept)))) >= sum(map(len, w)) else None


def some_edits(a, b, edits_in):
    """At most one edit in so many words of the shorter one, of lines that may have two or more; sets rule most pairs out."""
    least = min(len(a), len(b))
    most = least // edits_in
    if most < 2 or abs(len(a) - len(b)) > most or len(set(a) - set(b)) > most:
        return False
    return word_edits(a, b) <= most


def lines_by_hand(rows):
    seen, out = [], {}
    for d, text in sorted(rows.items()):
        kept = []
        for x in text.split("\n"):
            w = x.lower().split()
            if w and any(one_edit(w, v) or some_edits(w, v, 10) for v in seen):
                pass
            else:
                kept.append(x)
            if w:
                seen.append(w)
        if words_of(" ".join(kept)):
            out[d] = "\n".join(kept)
    return out


def leaks_by_hand(text, items):
    """Whether an item, or a segment of it, is in the text within a tenth of its characters; texts without the q-grams that it needs are not aligned."""
    fold = lambda t: re.sub(r"\s", " ", t).lower()
    text = fold(text)
    for item in map(fold, items):
        half = min(max(len(item) // 3, 48), 100) // 2
        starts = [*range(0, len(item) - 2 * half, half), len(item) - 2 * half] if len(item) >= 3 * half else []
        for part in [item, *(item[a : a + 2 * half] for a in starts)]:
            m = len(part)
            budget = max(min(int(0.1 * m), (m - 7) // 7), 0)
            # stretches of the text that overlap by more than a match is long
            for at in range(0, len(text), 2 * m):
                piece = text[at : at + 4 * m]
                if part in piece or sum(part[k : k + 7] in piece for k in range(m - 6)) >= max(1, m - 6 - 7 * budget) and edits(part, piece) <= budget:
                    return True
    return False


def test_pipeline_against_plain_python(spark):
    """Each stage's documents and texts, and the ids of every document that run() packs."""
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = lambda df: {r.doc_id: r.text for r in df.collect()}
    expected = {d: q for d, t in found(docs).items() if (q := quality_by_hand(t)) is not None}
    df = p.quality_rules(spark, docs, SF).cache()
    assert found(df) == expected and len(expected) > 0.7 * docs.count()
    for stage, by_hand in (
        (p.line_dedup, lines_by_hand),
        (p.near_duplicates, lambda rows: {d: rows[d] for d, (_, c) in joined(rows.items()).items() if c == d}),
        (p.decontamination, lambda rows: {d: t for d, t in rows.items() if not leaks_by_hand(t, bench)}),
    ):
        df, before, expected = stage(spark, df, SF).cache(), expected, by_hand(expected)
        assert found(df) == expected and df.columns == docs.columns and len(expected) <= len(before)
    pieces, tok, at = p.run(spark, SF).collect(), Tokenizer.from_file(PATH), defaultdict(int)
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in expected.items()}
    for x in sorted(pieces, key=lambda x: x.start):
        assert x.start == at[x.doc_id] and x.ids_crc32 == zlib.crc32(np.array(ids[x.doc_id][x.start : x.start + x.length], "<u4").tobytes())
        at[x.doc_id] += x.length
    assert at == {d: len(x) for d, x in ids.items()}


def test_pipeline_stages_on_edge_cases(spark):
    """Nulls in any column, empty and very long texts, repeated rows, an extra column, and no rows at all."""
    import corpus_pipeline as p

    clean = "Ten different words make this sentence long enough to stay here. "
    rows = [(1, clean, "en", "a", 5), (1, clean, "en", "a", 5), (None, clean + "More of them.", None, None, None), (3, None, None, "b", 0), (4, "", "en", None, None), (5, " ".join(f"w{k}" for k in range(30_000)) + ".", "en", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit("x"))
    for given in (df, df.limit(0)):
        for name, stage in p.STAGES:
            got = stage(spark, given, SF)
            n = got.count()
            assert name == "packing" or got.columns == df.columns and n <= given.count()
            assert n == 0 if given is not df else n > 0
    assert sorted((r.doc_id or 0) for r in p.quality_rules(spark, df, SF).collect()) == [0, 1, 1, 5]
    assert sorted((r.doc_id or 0) for r in p.near_duplicates(spark, df, SF).collect()) == [0, 1, 3, 4, 5]


def test_kept_hash(spark):
    r = queries.op2_substring_dedup(spark, SF).first()
    assert re.fullmatch("[0-9a-f]{64}", r.kept_sha256) and hashlib.sha256(b"").hexdigest() != ""
