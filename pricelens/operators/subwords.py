"""Subword tokens: greedy longest match of every word against a vocabulary of pieces.

The original hands its prompts to a pretrained tokenizer that cuts a word, from left to
right, into the longest pieces its vocabulary has.  Here the vocabulary is a public file of
byte pieces (one a line: base64, rank); its path is a parameter.  A piece that
starts with a space begins a word, any other goes on with it.

* Every *distinct* word is cut once.  Its substrings (no longer than the longest
  piece) are joined to the vocabulary by equality, the longest match at each place
  is one aggregate, and one fold over the places walks from match to match.  A word
  over ``MAX_WORD`` letters, or one that a place has no match for, is unknown as a whole, as the
  published algorithm has it.  No dictionary on any task or on the driver.
* A text's first ``max_length`` words are joined to the cut words; a group never
  holds more than that.  Words that many texts share are split by adaptive execution.

Id 0 is padding, 1 an unknown word; a piece's id is its rank + 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions import token_array
from pricelens.operators.tokens import ATTENTION_MASK, FIRST_ID, INPUT_IDS, UNK_ID, pad
from pricelens.session import landed

#: Letters of a word beyond which it is unknown (fixed value of the published algorithm).
MAX_WORD = 100
WORD, PIECE, PIECE_ID, IDS, KEY = "word", "piece", "id", "ids", "_text_key"


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``piece, id`` of a vocabulary file (base64 of the piece's bytes, a space, its rank); pieces that are no whole letters are left out."""
    rows = spark.read.schema("coded string, rank int").option("sep", " ").csv(path)
    piece = F.unbase64("coded").cast("string")
    return rows.where(F.is_valid_utf8(piece)).select(piece.alias(PIECE), (F.col("rank") + FIRST_ID).alias(PIECE_ID))


def cut_words(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """``word, ids`` of distinct words (ids: their pieces' ids, ``[1]`` for an unknown word)."""
    longest = pieces.select(F.max(F.length(PIECE))).scalar()
    known = words.where(F.length(WORD) <= MAX_WORD)
    spelled = known.select(WORD, F.concat(F.lit(" "), WORD).alias("_s"))
    places = spelled.select(WORD, "_s", F.explode(F.sequence(F.lit(1), F.length("_s"))).alias("_at"))
    sizes = F.sequence(F.lit(1), F.least(F.length("_s") - F.col("_at") + 1, longest))
    parts = places.select(WORD, "_s", "_at", F.explode(sizes).alias("_size")).select(WORD, "_at", F.substring(F.col("_s"), F.col("_at"), F.col("_size")).alias(PIECE))
    # only a piece with its space can begin the spelled word, so a match at 1 is that of the word's begin
    best = (parts.join(pieces, PIECE).groupBy(WORD, "_at")
            .agg(F.max(F.struct(F.length(PIECE).alias("n"), F.col(PIECE_ID).alias("id"))).alias("_m")))
    steps = best.groupBy(WORD).agg(F.sort_array(F.collect_list(F.struct(F.col("_at").alias("at"), "_m.n", "_m.id"))).alias("_steps"))  # at most MAX_WORD + 1
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ids"))
    walked = F.aggregate("_steps", begin, lambda done, s: F.when(s["at"] == done["at"], F.struct(
        (s["at"] + s["n"]).alias("at"), F.concat(done["ids"], F.array(s["id"])).alias("ids"))).otherwise(done))
    walked = steps.select(WORD, walked.alias("_w"))
    whole = F.col("_w.at") == F.length(WORD) + 2
    return (words.join(walked, WORD, "left")
                 .select(WORD, F.when(whole, F.col("_w.ids")).otherwise(F.array(F.lit(UNK_ID))).alias(IDS)))


def distinct_words(df: DataFrame, text: str, first: int | None = None) -> DataFrame:
    """``word, n`` of all words of a text column (of the first words of every text, if so asked)."""
    words = token_array(text) if first is None else F.slice(token_array(text), 1, first)
    return df.select(F.explode(words).alias(WORD)).groupBy(WORD).agg(F.count(F.lit(1)).alias("n"))


def tokenize(df: DataFrame, text: str, pieces: DataFrame, max_length: int) -> DataFrame:
    """``input_ids`` (the first ``max_length`` pieces, padded to the longest row) and ``attention_mask``; null for a null text.

    Every word is a piece at least, so later words than ``max_length`` can't matter.
    """
    cut = cut_words(distinct_words(df, text, max_length).select(WORD), pieces)
    keyed = df.withColumn(KEY, F.md5(text))
    texts = keyed.where(F.col(KEY).isNotNull()).select(KEY, F.slice(token_array(text), 1, max_length).alias("_words")).dropDuplicates([KEY])
    placed = texts.select(KEY, F.posexplode("_words").alias("_at", WORD)).join(cut, WORD)
    per_text = (placed.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("_at", IDS))).alias("_parts"))
                .select(KEY, F.slice(F.flatten(F.transform("_parts", lambda p: p[IDS])), 1, max_length).alias(INPUT_IDS)))
    encoded = (keyed.join(per_text, KEY, "left")
               .withColumn(INPUT_IDS, F.when(F.col(KEY).isNotNull(), F.coalesce(INPUT_IDS, F.array().cast("array<int>")))).drop(KEY))
    return pad(landed(encoded, "subwords"), max_length, INPUT_IDS, ATTENTION_MASK)  # written once, read for the length and the rows


def unknown_rate(df: DataFrame, text: str, pieces: DataFrame) -> DataFrame:
    """One row over all words of all texts: ``n_words, n_pieces, n_unknown, unknown_rate``."""
    words = landed(distinct_words(df, text), "subword-words")
    cut = words.join(cut_words(words.select(WORD), pieces), WORD)
    unknown = F.col(IDS) == F.array(F.lit(UNK_ID))
    told = cut.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_words"), F.coalesce(F.sum(F.col("n") * F.size(IDS)), F.lit(0)).alias("n_pieces"),
                   F.coalesce(F.sum(F.when(unknown, F.col("n"))), F.lit(0)).alias("n_unknown"))
    return told.withColumn("unknown_rate", F.when(F.col("n_words") > 0, F.col("n_unknown") / F.col("n_words")))
