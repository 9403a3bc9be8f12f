"""Long phrase ladders: the first phrase, by rank, that a text contains.

A short ladder is a ``CASE WHEN`` chain (``functions.phrase_tag``).  A long one would
make a plan no compiler takes, and test every phrase on every text.  Here the phrases
are one automaton (Aho-Corasick): a trie whose states fall back to their longest proper
suffix in it, each knowing the best rank among the phrases that end there.  A text
is read once, letter by letter, whatever the number of phrases, in Arrow batches next
to the scan: no shuffle.  The automaton goes to every task, so a ladder of more than
``MAX_LETTERS`` letters is cut by rank into parts of that size, and a text that an earlier part
has placed skips the later ones.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions import phrase_tag

#: Phrases up to which the plan tests them one by one.
SHORT = 100
#: Letters of the phrases of one automaton.
MAX_LETTERS = 2_000_000
NO_RANK = 1 << 62


class Automaton:
    """States are numbers: ``steps[s]`` maps letters to states, ``rank[s]`` is the best rank of a phrase that ends in ``s``."""

    def __init__(self, phrases: Sequence[str], first_rank: int = 0):
        self.steps: list[dict[str, int]] = [{}]
        self.rank = [NO_RANK]
        self.back = [0]
        for r, phrase in enumerate(phrases, first_rank):
            state = 0
            for letter in phrase:
                if letter not in self.steps[state]:
                    self.steps[state][letter] = len(self.steps)
                    self.steps.append({})
                    self.rank.append(NO_RANK)
                    self.back.append(0)
                state = self.steps[state][letter]
            self.rank[state] = min(self.rank[state], r)
        todo = deque([0])
        while todo:
            state = todo.popleft()
            for letter, target in self.steps[state].items():
                if state:
                    self.back[target] = self._follow(self.back[state], letter)
                self.rank[target] = min(self.rank[target], self.rank[self.back[target]])
                todo.append(target)
        self.best = min(self.rank)

    def _follow(self, state: int, letter: str) -> int:
        while state and letter not in self.steps[state]:
            state = self.back[state]
        return self.steps[state].get(letter, 0)

    def first(self, text: str) -> int | None:
        """The lowest rank of a phrase in the text."""
        steps, rank, back, best, state = self.steps, self.rank, self.back, self.rank[0], 0
        for letter in text:
            while (target := steps[state].get(letter)) is None and state:
                state = back[state]
            state = target or 0
            if rank[state] < best:
                best = rank[state]
                if best == self.best:  # nothing better can come
                    break
        return best if best < NO_RANK else None


def ladder_parts(ladder: Sequence[str], letters: int) -> list[tuple[int, list[str]]]:
    """(rank of the first phrase, phrases) of parts of at most about so many letters."""
    parts: list[tuple[int, list[str]]] = []
    held = letters + 1
    for r, phrase in enumerate(ladder):
        if held + len(phrase) > letters:
            parts.append((r, []))
            held = 0
        parts[-1][1].append(phrase)
        held += len(phrase)
    return parts


def add_first_phrase(df: DataFrame, text: str, ladder: Sequence[str], target: str = "phrase", letters: int | None = None) -> DataFrame:
    """``df`` with the first phrase of ``ladder`` that ``text`` contains (literally), else null.

    An empty phrase is in every text; a null text has none.  Of equal phrases the first counts.
    """
    if len(ladder) <= SHORT:
        return df.withColumn(target, phrase_tag(text, list(ladder)))
    rank = "_rank"
    names = [c for c in df.columns if c != target]
    told = df.select(*names, F.lit(None).cast("long").alias(rank))
    for first, phrases in ladder_parts(ladder, letters or MAX_LETTERS):
        automaton, schema, at = Automaton(phrases, first), told.schema, len(names)
        place = names.index(text)

        def run(batches: Iterator[pa.RecordBatch], automaton=automaton, at=at, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = batch.column(at).to_pylist()
                texts = batch.column(place).to_pylist()
                ranks = [k if k is not None or t is None else automaton.first(t) for k, t in zip(known, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(ranks, pa.int64())], names=batch.schema.names)

        told = told.mapInArrow(run, schema)
    # the phrase itself by its place in the ladder: a constant array, as long as the parameter
    phrase = F.element_at(F.lit(list(ladder)), (F.col(rank) + 1).cast("int"))
    return told.select(*names, F.when(F.col(rank).isNotNull(), phrase).alias(target))
