"""Search tokens: folded runs of letters, digits, private use, _ and -."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}_-]+"
#: The same in lower-case ASCII.
ASCII_TOKEN = "[a-z0-9_-]+"
#: Accents on their own are dropped.
LOOSE_ACCENT = "[̀-ͯ]"


@cache
def fold_table() -> tuple[str, str]:
    """Lower-case letters that are a base letter with one mark, and their bases; and the final sigma."""
    pairs = {"ς": "σ"}
    for point in range(0xA0, 0x10000):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) == 2 and unicodedata.category(parts[1]) == "Mn" and unicodedata.category(chr(point)) == "Ll" and parts[0].isalpha():
            pairs[chr(point)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


def folded(text: Column) -> Column:
    plain = F.translate(F.lower(text), *fold_table())
    return F.regexp_replace(plain, LOOSE_ACCENT, "")


def tokens(text: Column) -> Column:
    """Tokens of a text in order; null has none. ASCII texts need no folding but lower case, and a plainer pattern, which is much faster."""
    text = F.coalesce(text, F.lit(""))
    ascii_tokens = F.regexp_extract_all(F.lower(text), F.lit(ASCII_TOKEN), F.lit(0))
    return F.when(F.octet_length(text) == F.length(text), ascii_tokens).otherwise(F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0)))


def phrases(query: str) -> list[list[str]]:
    """The query's words, each as its tokens; words without a token are left out."""
    import regex

    plain = re.sub(LOOSE_ACCENT, "", query.lower().translate(str.maketrans(*fold_table())))
    found = [regex.findall(TOKEN, word) for word in plain.split()]
    return [f for f in found if f]
