"""Quality rules as a short-circuit cascade.

Each rule turns measures of a text into a verdict. On a small sample the cascade
measures what each rule costs, beyond measures that are made anyway, and how many texts
it rejects, and orders the rules by rejections per cost; each following rule then looks only at texts that all rules before
it let pass. The order changes the time, never the verdict, since a text is kept only
if no rule rejects it. Every text is read whole. Lines and windows of words that hash
alike are compared byte by byte before they count as equal.

Null texts count as empty. An empty text has no words. Repeated rows are judged each on
its own; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .session import batch, lean, quoted

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SPACE_BYTES = bytes(np.flatnonzero(~T.SPACES).tolist())
_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_IS_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
_IS_LETTER = _IS_UPPER | ((np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A))


class Texts:
    """A block of texts; each measure is made when first asked for."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1
        self._made: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made[name] = MEASURES[name](self)
        return self._made[name]

    def only(self, rows: np.ndarray) -> "Texts":
        """The texts of some rows, with the measures that are already known."""
        size = np.diff(self.at)[rows]
        at = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.at[rows] - at[:-1], size) + np.arange(at[-1])
        out = Texts(self.data[where], at)
        out._made = {k: v[rows] for k, v in self._made.items() if k[0] != "_"}
        return out

    def raw(self, row: int) -> bytes:
        return self.data[self.at[row] : self.at[row + 1]].tobytes()

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.at[1:]] - sums[self.at[:-1]]


def _words(x: Texts):
    return T.spans(x.data, x.at, T.SPACES)


def _word_chars(x: Texts) -> np.ndarray:
    return x.per_text(T.SPACES[x.data] & ((x.data & 0xC0) != 0x80))


def _dup_lines(x: Texts) -> np.ndarray:
    if not len(x.data):
        return np.zeros(x.n, np.int64)
    is_break = x.data == 0x0A
    starts = np.union1d(x.at[:-1][np.diff(x.at) > 0], np.flatnonzero(is_break) + 1)
    starts = starts[starts < len(x.data)]
    text = np.searchsorted(x.at, starts, "right") - 1
    breaks = np.append(np.flatnonzero(is_break), len(x.data))
    ends = np.minimum(breaks[np.searchsorted(breaks, starts)], x.at[text + 1])
    words = np.concatenate([[0], np.cumsum(T.SPACES[x.data])])
    full = words[ends] > words[starts]
    starts, ends, text = starts[full], ends[full], text[full]
    one, two = _twins(T.mix(T.word_hashes(x.data, starts, ends) + text.astype(np.uint64)))
    if not _equal(x, starts, ends, text, one, two):
        lines = [[part for part in x.raw(i).split(b"\n") if part.translate(None, _SPACE_BYTES)] for i in range(x.n)]
        return np.array([len(own) - len(set(own)) for own in lines], np.int64)
    return np.bincount(text[two], minlength=x.n)


def _repeat_words(x: Texts, width: int = 5) -> np.ndarray:
    starts, ends, first = x["_words"]
    n = len(starts)
    if n < width:
        return np.zeros(x.n, np.int64)
    text = np.repeat(np.arange(x.n), np.diff(first))
    inside = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    key = T.run_hashes(T.word_hashes(x.data, starts, ends), width)[inside]
    one, two = (inside[k] for k in _twins(T.mix(key + text[inside].astype(np.uint64))))
    if not all(_equal(x, starts, ends, text, one + j, two + j) for j in range(width)):
        return np.array([_plain_repeats(x.raw(i), width) for i in range(x.n)], np.int64)
    cover = np.zeros(n + 1, np.int64)
    at = np.union1d(one, two)
    cover[at] += 1
    np.subtract.at(cover, at + width, 1)
    covered = np.cumsum(cover[:n]) > 0
    return np.bincount(text[covered], minlength=x.n)


def _twins(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal keys, each but the first of its kind beside the one before it."""
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    return order[same], order[same + 1]


def _equal(x: Texts, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, one: np.ndarray, two: np.ndarray) -> bool:
    """Whether the parts at ``one`` are those at ``two``, in the same texts, as their hashes say."""
    size = ends - starts
    if (size[one] != size[two]).any() or (text[one] != text[two]).any():
        return False
    return bool(T.same_bytes(x.data, starts[one], starts[two], size[one]).all())


def _plain_repeats(raw: bytes, width: int) -> int:
    words = raw.split()  # on bytes, at just the six bytes that part words
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    times = Counter(windows)
    return len({p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + width)})


MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "_words": _words,
    "n_words": lambda x: np.diff(x["_words"][2]),
    "word_chars": _word_chars,
    "n_symbols": lambda x: x.per_text(_IS_SYMBOL[x.data]),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_upper": lambda x: x.per_text(_IS_UPPER[x.data]),
    "n_letters": lambda x: x.per_text(_IS_LETTER[x.data]),
    "n_bangs": lambda x: x.per_text(x.data == 0x21),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a block of texts and gives one boolean for each."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


#: A text is rejected for fewer than 10 words, or if repeated 5-word windows cover over a fifth of its words.
BASE_RULES = (
    Rule("few_words", lambda x: x["n_words"] < 10),
    Rule("repeated_words", lambda x: 100 * x["n_repeat_words"] > 20 * x["n_words"]),
)
#: Further rules of the usual kind: symbols, word length, repeated lines, shouting.
MORE_RULES = (
    Rule("symbols", lambda x: 10 * x["n_symbols"] > x["n_words"]),
    Rule("word_length", lambda x: (x["word_chars"] < 2 * x["n_words"]) | (x["word_chars"] > 15 * x["n_words"])),
    Rule("repeated_lines", lambda x: 10 * x["n_dup_lines"] > 3 * np.maximum(1, x.per_text(x.data == 0x0A) + 1)),
    Rule("capitals", lambda x: 2 * x["n_upper"] > np.maximum(1, x["n_letters"])),
    Rule("exclamations", lambda x: 5 * x["n_bangs"] > x["n_words"]),
)


def passes(x: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """The rows that no rule rejects; each rule sees only those that are still in."""
    alive = np.arange(x.n)
    for rule in rules:
        if not len(alive):
            break
        out = rule.rejects(x)
        if out.any():
            alive, x = alive[~out], x.only(np.flatnonzero(~out))
    return alive


def trial(texts: pa.Array, rules: Sequence[Rule], made: Sequence[str] = ()) -> list[tuple[float, int, int]]:
    """(seconds, rejected texts, texts) of each rule, each on its own, without the time of the measures that are ``made`` before."""
    out = [(0.0, 0, 0)] * len(rules)
    for _, _, data, at in T.blocks(texts):
        for k, rule in enumerate(rules):
            x = Texts(data, at)
            for name in made:
                x[name]
            began = time.perf_counter()
            rejected = int(rule.rejects(x).sum())
            out[k] = (out[k][0] + time.perf_counter() - began, out[k][1] + rejected, out[k][2] + x.n)
    return out


def ranked(rules: Sequence[Rule], trials: Sequence[tuple[float, int, int]]) -> list[Rule]:
    """The rules by rejections per second, the best first."""
    worth = [(rejected + 0.5) / (n + 1) / max(seconds, 1e-6) for seconds, rejected, n in trials]
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -worth[k])]


def order_rules(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", made: Sequence[str] = (), sample_rows: int = 256) -> list[Rule]:
    """Orders the rules by what they did on about ``sample_rows`` rows; only the speed depends on them.

    The rules are tried where the rows are; only each rule's figures come to the driver.
    """
    rules, names = tuple(rules), tuple(made)
    texts = docs.select(F.col(quoted(text_col)).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seconds, rejected, n = zip(*trial(b.column(0), rules, names), strict=True)
            yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "seconds": seconds, "rejected": rejected, "n": n})

    for rows in (texts.sample(0.01, seed=5), texts):
        tried = rows.limit(sample_rows).mapInArrow(lean(run), "rule long, seconds double, rejected long, n long")
        found = {r.rule: (r.seconds, r.rejected, r.n) for r in tried.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("seconds", "rejected", "n"))).collect()}
        if found:
            return ranked(rules, [found[k] for k in range(len(rules))])
    return list(rules)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns unchanged."""
    rules = order_rules(docs, rules, text_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in T.blocks(b.column(place)):
                kept = passes(Texts(data, at), rules)
                yield b.slice(lo, hi - lo).take(pa.array(kept))

    return docs.mapInArrow(lean(run), docs.schema)


def score_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Sequence[Rule] = BASE_RULES, more: Sequence[Rule] = MORE_RULES) -> DataFrame:
    """The measures of every text, whether a base rule rejects it, and whether no rule does."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    cascade = order_rules(docs, more, text_col, ["_words", *names])
    base = tuple(base)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([(id_col, b.schema.field(0).type), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
            for lo, hi, data, at in T.blocks(b.column(1)):
                x = Texts(data, at)
                measures = [x[n] for n in names]
                failed = np.zeros(x.n, bool)
                for rule in base:
                    failed |= rule.rejects(x)
                kept = np.zeros(x.n, bool)
                left = np.flatnonzero(~failed)
                if len(left):
                    kept[left[passes(x.only(left), cascade)]] = True
                yield batch(schema, b.column(0).slice(lo, hi - lo), *measures, failed, kept)

    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(
        lean(run), f"{quoted(id_col)} {id_type}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    )
