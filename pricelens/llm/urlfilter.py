"""URL filter: glob rules packed into multiword Shift-And masks.

Every glob is a row of automaton positions; all rules together are one bit
string cut into 64-bit words.  One step per URL byte moves all rules at
once: shift (with carry between words), AND the byte's mask, OR the positions
a ``*`` holds.  URLs of an Arrow batch advance together, one numpy row each,
so a step costs a few vector operations for the whole batch.

Edge cases: a null URL or one without ``://`` has empty host and path and
goes through the same automaton (as the canonical URL ``""``); the empty
table gives an empty result; columns of the input are kept unless they
clash with an output column, in which case the output column wins.  Rows that
repeat are judged each; a URL of any length is stepped through whole, a byte of
it a step of its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class HostRule:
    """Applies to ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"

    def globs(self) -> list[str]:
        """Globs over ``.host`` + path: the leading dot makes ``host`` itself
        and every subdomain end in ``.host``."""
        return [f"*.{_escape(self.host)}{SEP}{_escape(self.path)}*"]


#: Between host and path in a canonical URL: a byte that UTF-8 never holds,
#: so a ``*`` meant for the host can't be satisfied by text of the path.
SEP = "\udcff"


def _escape(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; null: empty."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Automaton:
    """Masks of all globs over 64-bit words; ``owner[i]`` is the rule of accept bit ``i``."""

    byte_masks: np.ndarray  # [256, words]: positions a byte may enter
    hold: np.ndarray        # [words]: positions that a star repeats
    start: np.ndarray       # [words]: positions open before the first byte
    skip: np.ndarray        # [words]: positions passed without a byte (star tails)
    accept: list[tuple[int, int, int]]  # (word, bit, rule)


def _tokens(glob: str) -> list[tuple[str, int]]:
    """(kind, byte) per position: ``lit``, ``any`` or ``star``."""
    out: list[tuple[str, int]] = []
    chars = iter(glob)
    for c in chars:
        if c == "*":
            if not out or out[-1][0] != "star":
                out.append(("star", 0))
        elif c == "?":
            out.append(("any", 0))
        else:
            if c == "\\":
                c = next(chars, "\\")
            out.extend(("lit", b) for b in c.encode("utf-8", "surrogateescape"))
    return out


def compile_globs(globs: list[tuple[str, int]]) -> Automaton:
    """Pack (glob, rule number) pairs; each glob matches the whole canonical URL.

    A glob of m tokens takes m + 1 bits: bit j is set when its first j
    tokens have been matched.  A star's bit is entered from the bit before it
    without a byte and holds itself on every byte.
    """
    bits = sum(len(_tokens(g)) + 1 for g, _ in globs)
    words = max(1, (bits + 63) // 64)
    byte_masks = np.zeros((256, words), np.uint64)
    hold, start, skip = (np.zeros(words, np.uint64) for _ in range(3))
    accept, at = [], 0
    one = np.uint64(1)

    def put(mask: np.ndarray, i: int) -> None:
        mask[..., i // 64] |= one << np.uint64(i % 64)

    for glob, rule in globs:
        tokens = _tokens(glob)
        put(start, at)
        for j, (kind, b) in enumerate(tokens, 1):
            if kind == "star":
                put(hold, at + j)
                put(skip, at + j)
            elif kind == "any":
                put(byte_masks, at + j)
            else:
                put(byte_masks[b], at + j)
        end = at + len(tokens)
        accept.append((end // 64, end % 64, rule))
        at = end + 1
    return Automaton(byte_masks, hold, start, skip, accept)


def _shifted(state: np.ndarray) -> np.ndarray:
    """Every bit one up, carried from word to word."""
    out = state << np.uint64(1)
    out[:, 1:] |= state[:, :-1] >> np.uint64(63)
    return out


def run(automaton: Automaton, texts: list[bytes]) -> np.ndarray:
    """[urls, globs] booleans: which globs match each whole text.

    Texts are stepped longest first, so at byte j only the rows that still
    have a byte take part; memory is the batch's text plus one state each.
    """
    n = len(texts)
    sizes = np.fromiter((len(t) for t in texts), np.int64, n)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
    live = sizes[order]
    state = np.tile(automaton.start, (n, 1))
    state |= _shifted(state) & automaton.skip  # stars at the front need no byte
    for j in range(int(live[0]) if n else 0):
        k = int(np.searchsorted(-live, -j, side="left"))  # rows longer than j
        mask = automaton.byte_masks[data[begin[:k] + j]]
        now = state[:k]
        nxt = (_shifted(now) & mask) | (now & automaton.hold)
        nxt |= _shifted(nxt) & automaton.skip  # a star after the token just matched
        state[:k] = nxt
    hits = np.zeros((n, len(automaton.accept)), bool)
    for i, (word, bit, _) in enumerate(automaton.accept):
        hits[order, i] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) != 0
    return hits


def filter_urls(pages: DataFrame, rules: list[HostRule], block_globs: list[str],
                url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest host rule that fits decides (equally long ones: the first
    listed); where none fits, a URL that any of ``block_globs`` (over host +
    path) matches is blocked, and the rest get ``default``.
    One scan, no shuffle; the rules travel in the task closure.
    """
    globs = [(g, i) for i, r in enumerate(rules) for g in r.globs()]
    n_rules = len(rules)
    globs += [(g.replace("/", SEP + "/", 1), n_rules) for g in block_globs]
    automaton = compile_globs(globs)
    owners = np.array([r for _, r in globs], np.int64)
    # by falling length; the place in the list settles ties
    preference = sorted(range(n_rules), key=lambda i: (-len(rules[i].text), i))
    names = [r.text for r in rules]
    verdicts = [r.verdict for r in rules]

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    located = pages.select(*kept, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    schema = located.select("*", F.lit("").alias("rule"), F.lit("").alias("verdict")).schema
    for name in ("rule", "verdict", "host", "path"):
        schema[name].nullable = True

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        separator = SEP.encode("utf-8", "surrogateescape")
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            paths = batch.column("path").to_pylist()
            hits = run(automaton, [b"." + h.encode() + separator + p.encode() for h, p in zip(hosts, paths, strict=True)])
            by_rule = np.zeros((len(hosts), n_rules + 1), bool)
            for i, owner in enumerate(owners):
                by_rule[:, owner] |= hits[:, i]
            rule = np.full(len(hosts), -1)
            for i in reversed(preference):
                rule[by_rule[:, i]] = i
            verdict = [verdicts[r] if r >= 0 else BLOCK if by_rule[k, n_rules] else default for k, r in enumerate(rule)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([names[r] if r >= 0 else None for r in rule], pa.string()), pa.array(verdict, pa.string())],
                names=[*batch.schema.names, "rule", "verdict"])

    return located.mapInArrow(judge, schema)
