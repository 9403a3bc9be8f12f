"""Word tokens, a fitted vocabulary, and padded id / mask arrays.

The original feeds ``tokenizer(texts, truncation=True, padding=True,
max_length=n)`` with a pretrained vocabulary.  Here the vocabulary is fitted
on the training rows (frequency rank, ties by token), and encoding is a
chain of DataFrame steps:

* tokens: ``split`` on runs of non letters/digits (any script), lower case;
* vocabulary: ``explode -> groupBy(token).count`` (partial aggregation),
  ranked by a distributed global sort -- no driver-side dictionary, no cap
  on its size;
* ids: each *distinct* text is encoded once (prompts repeat a lot), under its
  md5, so texts are neither shuffle nor join keys: its first ``max_length`` tokens are exploded with their position, joined to
  the vocabulary (planner's choice: broadcast when AQE measures it small,
  shuffle otherwise), and folded back per text -- a group never holds more
  than ``max_length`` entries;
* padding: to the longest encoded row, ``L = min(max_length, max tokens)``,
  one scalar aggregate over the texts themselves (a row's id count is
  ``min(n_tokens, max_length)``), so the encoding plan runs once.

Id 0 is padding, 1 an unknown token; vocabulary ids start at 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions import token_array
from pricelens.operators.ranking import global_rank

PAD_ID = 0
UNK_ID = 1
FIRST_ID = 2

TOKEN = "token"
TOKEN_ID = "id"
FREQ = "freq"
INPUT_IDS = "input_ids"
ATTENTION_MASK = "attention_mask"
N_TOKENS = "n_tokens"
KEY = "_text_key"


def fit_vocabulary(df: DataFrame, text: str, min_count: int = 1) -> DataFrame:
    """``token, id, freq`` over every token of ``text`` (whole texts)."""
    counts = (df.select(F.explode(token_array(text)).alias(TOKEN))
                .groupBy(TOKEN).agg(F.count(F.lit(1)).alias(FREQ)))
    if min_count > 1:
        counts = counts.filter(F.col(FREQ) >= min_count)
    ranked = global_rank(counts, [F.col(FREQ).desc(), F.col(TOKEN).asc()], "_rank")
    return ranked.select(TOKEN, (F.col("_rank") + (FIRST_ID - 1)).cast("int").alias(TOKEN_ID), FREQ)


def encode(df: DataFrame, text: str, vocabulary: DataFrame, max_length: int) -> DataFrame:
    """Add ``input_ids`` (first ``max_length`` token ids, unpadded) and
    ``n_tokens`` (token count of the whole text)."""
    keyed = df.withColumn(KEY, F.md5(text))
    texts = keyed.filter(F.col(KEY).isNotNull()).select(KEY, F.slice(token_array(text), 1, max_length).alias("_tokens")).dropDuplicates([KEY])
    pieces = texts.select(KEY, F.posexplode("_tokens").alias("_pos", TOKEN))
    ided = (pieces.join(vocabulary.select(TOKEN, TOKEN_ID), TOKEN, "left")
                  .select(KEY, "_pos", F.coalesce(F.col(TOKEN_ID), F.lit(UNK_ID)).alias(TOKEN_ID)))
    per_text = (ided.groupBy(KEY)
                    .agg(F.array_sort(F.collect_list(F.struct("_pos", TOKEN_ID))).alias("_pairs"))
                    .select(KEY, F.transform("_pairs", lambda s: s[TOKEN_ID]).alias(INPUT_IDS)))
    empty = F.array().cast("array<int>")
    return (keyed.join(per_text, KEY, "left")
                 .withColumn(INPUT_IDS, F.when(F.col(KEY).isNotNull(), F.coalesce(F.col(INPUT_IDS), empty)))
                 .withColumn(N_TOKENS, F.size(token_array(text))).drop(KEY))


def pad(df: DataFrame, max_length: int, ids: str = INPUT_IDS, mask: str = ATTENTION_MASK,
        longest=None) -> DataFrame:
    """Pad ``ids`` with 0 to ``L = min(max_length, longest row)``; mask 1 for tokens, 0 for padding.

    ``longest``: a Column (scalar) with the longest row's token count, when
    the caller has a cheaper source for it than ``df`` itself.
    """
    if longest is None:
        longest = df.select(F.max(F.size(ids))).scalar()
    length = F.least(F.lit(int(max_length)), F.coalesce(longest, F.lit(0)))
    size = F.size(ids)
    gap = length - size
    return (df.withColumn(mask, F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), gap)))
              .withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(PAD_ID), gap))))


def tokenize(df: DataFrame, text: str, vocabulary: DataFrame, max_length: int) -> DataFrame:
    """Encode and pad: ``input_ids``, ``attention_mask``, ``n_tokens``."""
    longest = df.select(F.max(F.size(token_array(text)))).scalar()
    return pad(encode(df, text, vocabulary, max_length), max_length, longest=longest)
