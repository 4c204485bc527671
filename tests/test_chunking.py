import random
from itertools import pairwise

import pytest

from tidewater.errors import ChunkingError
from tidewater.functions.text import id_of, path_of
from tidewater.operators.chunking import chunks, cuts, sections


def paths(text):
    return [("/".join(p), text[a:b]) for p, a, b in sections(text)]


def test_headings_open_sections_and_skipped_levels_have_no_placeholder():
    text = "intro\n# A\n### C\nx\n## B\n# D #\n"
    assert [p for p, _ in paths(text)] == ["", "A", "A/C", "A/B", "D"]


@pytest.mark.parametrize("line", ["#", "### ###", "####### x", " # x", "#x"])
def test_what_is_no_heading(line):
    assert paths(line + "\n") == [("", line + "\n")]


def test_fences_hide_headings_and_an_open_one_takes_the_rest():
    assert [p for p, _ in paths("```py\n# no\n```\n# yes\n~~~~\n# no\n~~~\n# no")] == ["", "yes"]
    assert [p for p, _ in paths("```x```\n# no\n")] == [""]


def test_cuts_prefer_paragraphs_then_lines_then_anything():
    assert [b - a for a, b in pairwise(cuts("aa\n\nbb\n\ncc", 9))] == [8, 2]
    assert [b - a for a, b in pairwise(cuts("x" * 37, 15))] == [15, 15, 7]
    assert cuts("", 5) == []


def test_parts_cover_any_text_and_keep_the_bound():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bb ", "\n", "\n\n", "# h\n", "```\n", "\x0c", "\u2028", "é"]) for _ in range(rng.randint(0, 60)))
        assert "".join(t for _, t in paths(text)) == text
        bound = rng.randint(1, 20)
        parts = [text[a:b] for a, b in pairwise(cuts(text, bound))]
        assert "".join(parts) == text and all(0 < len(p) <= bound for p in parts)


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("doc_a", "# T\r\nx\r# T\ny", "markdown"), ("doc_b", "", "markdown"), ("doc_c", None, "plain_text"), ("doc_d", "# no", "plain_text")], "document_id string, text string, format string")
    rows = chunks(docs).orderBy("document_id", "ordinal").collect()
    assert [(r.document_id, r.section_path, r.section_occurrence, r.ordinal, r.text) for r in rows] == [("doc_a", ["T"], 0, 0, "# T\nx\n"), ("doc_a", ["T"], 1, 1, "# T\ny"), ("doc_d", [], 0, 0, "# no")]
    assert rows[1].chunk_id == id_of("chunk_", "doc_a", "T", 1, 0) and rows[0].char_count == 6
    with pytest.raises(ChunkingError):
        chunks(docs, max_chunk_chars=0)


@pytest.mark.parametrize("bad", ["", " ", "/a", "C:/a", "a//b", "a/../b", "."])
def test_paths_refused(bad):
    with pytest.raises(ValueError):
        path_of(bad)


def test_paths_normalised():
    assert path_of(".\\a\\.\\b.md") == "a/b.md"
