"""Line-first quality rules, as DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import WORD_GAP, let, words_of

#: A line with a word.
SAYS = r"[^\x20\x09-\x0D]"
#: Punctuation: prose ends with a sentence end, quotes and brackets may follow.
SENTENCE_END = r"[.!?…。！？؟।][\"'”’»)\]]*[\x20\x09-\x0D]*\z"
#: Marks that stand for layout or markup, not prose.
SYMBOL = r"[#*$%&|<>]"
#: Doubled marks.
SHOUT = r"[!?]{2,}"
#: Navigation: items parted by such marks, with space around.
SEPARATOR = r"(^| )[|»›•·→]+( |$)"

# fixed values of the rules, in English, French, German and Spanish
#: What short lines for finding one's way say.
NAVIGATION_PHRASES = (
    "skip to content", "skip to main content", "back to top", "next page", "previous page", "read more", "sign in", "log in", "sign up", "main menu",
    "aller au contenu", "haut de page", "page suivante", "page précédente", "lire la suite", "se connecter", "menu principal",
    "zum inhalt springen", "nach oben", "nächste seite", "vorherige seite", "weiterlesen", "anmelden", "hauptmenü",
    "ir al contenido", "volver arriba", "página siguiente", "página anterior", "leer más", "iniciar sesión", "menú principal",
)
#: What notices say.
BOILERPLATE_PHRASES = (
    "all rights reserved", "cookie policy", "cookies policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum",
    "subscribe to our newsletter", "click here to", "licensed under", "released under the", "copyright (c)", "copyright ©",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "activer javascript", "cliquez ici pour", "sous licence",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "javascript aktivieren", "hier klicken", "lizenziert unter",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "condiciones de uso", "active javascript", "haga clic aquí", "bajo la licencia",
)
#: Lines of at most so many words are short.
SHORT = 10


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """Any of the phrases, not inside a word; upper or lower case is for the engine to ignore."""
    return r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(p.replace("(", r"\(").replace(")", r"\)").replace(" ", " +") for p in phrases) + r")(?:\z|[^\p{L}\p{N}])"


def _count(line: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))


def line_passes(line: Column) -> Column:
    """Whether a line passes the punctuation, navigation and boilerplate rules.

    Punctuation: a sentence end at the line's end, no more than one symbol to five
    words and no more than three in ten words followed by doubled marks (!!, ??).
    Navigation: fewer than three separators, or under one to five words; and no
    navigation phrase in a line of ten words or fewer. Boilerplate: none of the
    phrases. A line without a word passes.
    """
    words = _count(line, r"[^\x20\x09-\x0D]+")
    has = lambda phrases: line.rlike("(?iu)" + phrase_pattern(phrases))
    # words are counted only where one of the rules needs them
    return ~line.rlike(SAYS) | (
        line.rlike(SENTENCE_END)
        & (~line.rlike(SYMBOL) | (5 * _count(line, SYMBOL) <= words))
        & (~line.rlike(SHOUT) | (10 * _count(line, SHOUT) <= 3 * words))
        & ~(line.rlike(SEPARATOR) & (_count(line, SEPARATOR) >= 3) & (5 * _count(line, SEPARATOR) >= words))
        & ~(has(NAVIGATION_PHRASES) & (words <= SHORT))
        & ~has(BOILERPLATE_PHRASES)
    )


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words lie in a window of `width` words that the array holds twice or more."""

    def covered(grams: Column) -> Column:
        ranked = F.sort_array(F.transform(grams, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def places(r: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(r, a)["h"] == F.get(r, b)["h"], F.lit(False))
            twice = F.filter(F.transform(r, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["k"])), lambda k: k.isNotNull())
            return F.sort_array(twice)

        def union(p: Column) -> Column:
            gap = F.transform(p, lambda k, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - k, F.lit(width))))
            return F.aggregate(gap, F.lit(0), lambda a, b: a + b)

        return let(let(ranked, places), union)

    def counted(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))

    return let(words, lambda w: F.when(F.size(w) < width + 1, 0).otherwise(counted(w)))


def quality(docs: DataFrame, *, max_loss: float = 0.5, text_col: str = "text") -> DataFrame:
    """Adds to docs one struct column `quality`: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), n_lines,
    n_failed_lines, removed_chars (long) and cleaned, the text of the lines that
    pass (string).

    Base: fewer than 10 words, or over a fifth of the words repeated in five-word
    windows. Then each line is judged on its own (line_passes); failing lines go,
    and the document is rejected if those held more than `max_loss` of the
    characters of its words. Everything happens within the row; nothing is
    shuffled and no Python runs. The struct comes out of a generator, so that a
    filter on it is not pushed below it and no row is judged twice.

    Null text: no words, cleaned null, failed. Empty text: no words, failed.
    Very long texts: arrays of a row's words and lines are held, so memory grows
    with the longest text. Repeated rows: judged alike. Any other columns, also one
    named quality, which is replaced, play no part. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def without(t: Column) -> Column:
        for gap in WORD_GAP + " ":
            t = F.replace(t, F.lit(gap), F.lit(""))
        return t

    def judged(t: Column) -> Column:
        lines = F.split(t, "\n")

        def of_lines(ls: Column) -> Column:
            said = F.filter(ls, lambda x: x.rlike(SAYS))
            return F.struct(
                let(said, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.size(said).cast("long").alias("n_lines"),
                F.transform(ls, lambda x: F.struct(x.alias("line"), line_passes(x).alias("ok"))).alias("each"),
            )

        def of_words(w: Column) -> Column:
            return F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("again"))

        def result(v: Column) -> Column:
            return let(
                F.array_join(F.transform(F.filter(v["lines"]["each"], lambda x: x["ok"]), lambda x: x["line"]), "\n"),
                lambda cleaned: let(
                    F.struct(v["chars"].alias("all"), F.length(without(cleaned)).cast("long").alias("left")),
                    lambda c: F.struct(
                        v["words"]["n"].alias("n_words"),
                        c["all"].alias("word_chars"),
                        v["symbols"].alias("n_symbols"),
                        v["lines"]["n_dup_lines"].alias("n_dup_lines"),
                        v["words"]["again"].alias("n_repeat_words"),
                        _base_failed(v["words"]).alias("base_failed"),
                        (~_base_failed(v["words"]) & (c["all"] - c["left"] <= max_loss * c["all"])).alias("kept"),
                        v["lines"]["n_lines"].alias("n_lines"),
                        F.size(F.filter(v["lines"]["each"], lambda x: ~x["ok"])).cast("long").alias("n_failed_lines"),
                        (c["all"] - c["left"]).alias("removed_chars"),
                        F.when(v["known"], cleaned).alias("cleaned"),
                    ),
                ),
            )

        facts = F.struct(
            let(words_of(t), of_words).alias("words"),
            F.length(without(t)).cast("long").alias("chars"),
            (F.length(t) - F.length(F.regexp_replace(t, SYMBOL, ""))).cast("long").alias("symbols"),
            let(lines, of_lines).alias("lines"),
            F.col(text_col).isNotNull().alias("known"),
        )
        return let(facts, result)

    return docs.drop("quality").withColumn("quality", F.explode(F.array(let(text, judged))))


def _base_failed(words: Column) -> Column:
    return (words["n"] < 10) | (100 * words["again"] > 20 * words["n"])
