"""Token counts by a two-tier lookup on the map side; nothing is shuffled."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidewater.llm.tokens import encoder, vocabulary_pieces


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts the tokens of every whole text, as the tokenizers library does
    without begin or end tokens: (id, n_bytes, n_tokens, over_limit).

    Tier one is a broadcast table of the vocabulary's own pre-tokens and their
    lengths, no larger than the vocabulary. Tier two is a cache of bounded size
    in each Python worker, which encodes a piece once. Pieces are what merges
    cannot cross: words with the space before them; a text with other white
    space, or with special strings, is cut by the full pre-token pattern.

    Null and empty texts: no bytes, no tokens. Very long texts are counted whole, in their task. Null ids and repeated rows: a row
    each. Extra columns are not read. An empty table gives an empty one.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(vocabulary_pieces(tokenizer))

    def count(batches):
        enc = encoder(tokenizer, "count", frequent.value)
        for batch in batches:
            texts = batch.column(1)
            n = [sum(enc.parts(t)) if t else 0 for t in texts.to_pylist()]
            n = pa.array(n, pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, pc.greater(n, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(id_col, text_col).mapInArrow(count, schema)
