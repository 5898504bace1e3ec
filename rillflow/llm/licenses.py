"""License scan by conditional compression.

Words of a notice that must survive if it is to count as that notice (its longest ones,
one more than may differ) name candidate blocks around them; a long run of blocks is cut
into overlapping blocks of twice the longest notice, so that work grows in proportion to
the text. A template of which a block lacks more words than may differ is no candidate in
it. The block is compressed alone and with each candidate as a raw zstandard dictionary;
candidates are ranked by how much smaller it gets. The winner, with those that come within
``MARGIN`` bytes of it, is confirmed by the exact number of words that must be inserted,
dropped or replaced to turn the template into some part of the block, at most a fifth of
its words; the one with the smallest share of differences counts. Only if none of them is
confirmed is the next in the ranking tried. What is left of the block is looked at again.

Of notices that overlap, the one with the smaller share of differences stays, then the
longer, then the earlier.

Words are runs of a-z, 0-9 and characters beyond ASCII, once A-Z are lower-cased. Every text
is read whole in one pass over the scan, without a shuffle. Null and empty texts hold no
notice; repeated rows are scanned each on its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import text as T
from .decontaminate import _Docs, _hash_words, _item_words
from .license_texts import TEMPLATES
from .session import batch, lean, quoted

LEVEL = 3
#: Bytes of size reduction by which rivals may miss the winner and still be confirmed beside it: what a
#: compressor's framing and a few words more or less in the dictionary can make.
MARGIN = 12


def allowed(n_words: int) -> int:
    return n_words // 5


def differences(template: Sequence, block: Sequence) -> tuple[int, int, int]:
    """(fewest word edits, start, end) of the part of the block nearest to the template; the earliest such part, then the shortest."""
    numbers: dict = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for w in block], np.int64)
    # edits << 32 | start, so that the smaller number has fewer edits, then the earlier start
    one = np.int64(1) << 32
    best = np.arange(len(words) + 1)
    steps = np.arange(len(words) + 1) * one
    for word in template:
        new = best + one
        np.minimum(new[1:], best[:-1] + one * (words != numbers.get(word, -1)), out=new[1:])
        best = np.minimum.accumulate(new - steps) + steps
    end = int(best.argmin())
    return int(best[end] >> 32), int(best[end] & 0xFFFFFFFF), end


class _Template:
    def __init__(self, license_id: str, wording: str):
        self.license_id, self.words = license_id, _item_words(wording)
        self.text = b" ".join(self.words)
        self.slack = allowed(len(self.words))
        self.times = Counter(self.words)
        distinct = sorted(dict.fromkeys(self.words), key=lambda w: (-len(w), w))
        #: Where each word that must survive stands; words that stand at several places count for each.
        need, names = self.slack + 1, []
        for w in distinct:
            names.append(w)
            need -= self.words.count(w)
            if need <= 0:
                break
        self.anchors = [(w, i) for i, w in enumerate(self.words) if w in names]

    @cached_property
    def compressor(self) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(self.text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known)

    def may_fit(self, times: Mapping[bytes, int]) -> bool:
        """Whether a block with these words has enough of the template's; each difference costs one at most."""
        lacking = self.slack
        for word, n in self.times.items():
            lacking -= max(0, n - times.get(word, 0))
            if lacking < 0:
                return False
        return True


class Scanner:
    def __init__(self, templates: Mapping[str, Sequence[str]]):
        self.templates = [_Template(k, w) for k, v in templates.items() for w in v]
        words = sorted({w for t in self.templates for w, _ in t.anchors})
        hashes = _hash_words(words)
        order = np.argsort(hashes)
        self.table = hashes[order]
        self.places = [[(t, i) for t in self.templates for w, i in t.anchors if w == words[o]] for o in order]
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.longest = max((len(t.words) + t.slack for t in self.templates), default=1)

    def blocks(self, d: _Docs) -> Iterator[tuple[int, int]]:
        """Word ranges of candidate blocks; those that overlap are one, cut to what any notice fits in whole."""
        for a, z in self._ranges(d):
            for lo in range(a, max(a + 1, z - self.longest), self.longest):
                yield lo, min(z, lo + 2 * self.longest)

    def _ranges(self, d: _Docs) -> Iterator[tuple[int, int]]:
        where = np.minimum(np.searchsorted(self.table, d.hashes), len(self.table) - 1)
        found = np.flatnonzero(self.table[where] == d.hashes)
        held: tuple[int, int] | None = None
        ranges = []
        for p in found.tolist():
            lo, hi = int(d.first[d.text[p]]), int(d.first[d.text[p] + 1])
            for t, i in self.places[where[p]]:
                ranges.append((max(lo, p - i - t.slack), min(hi, p - i + len(t.words) + t.slack)))
        for a, z in sorted(ranges):
            if held and a < held[1] and d.text[a] == d.text[held[0]]:
                held = (held[0], max(held[1], z))
            else:
                if held:
                    yield held
                held = (a, z)
        if held:
            yield held

    def ranking(self, part: Sequence[bytes]) -> list[tuple[int, _Template]]:
        """(bytes saved, template) of the candidates in a block, the most first."""
        times = Counter(part)
        fit = [t for t in self.templates if t.may_fit(times)]
        if not fit:
            return []
        block = b" ".join(part)
        alone = len(self.plain.compress(block))
        return sorted(((alone - len(t.compressor.compress(block)), t) for t in fit), key=lambda x: -x[0])

    def winner(self, part: Sequence[bytes]) -> tuple | None:
        """(share of differences, -words, start, end, differences, license) of the notice that the ranking and the wording name."""
        ranked = self.ranking(part)
        while ranked:
            rivals = [t for saved, t in ranked if saved >= ranked[0][0] - MARGIN]
            found = [(edits / len(t.words), -len(t.words), a, z, edits, t.license_id) for t in rivals for edits, a, z in [differences(t.words, part)] if edits <= t.slack]
            if found:
                return min(found)
            ranked = ranked[len(rivals) :]
        return None

    def notices(self, words: list[bytes]) -> list[tuple]:
        """Like ``winner``, of all notices in one block."""
        out = []
        todo = [(0, len(words))]
        while todo:
            lo, hi = todo.pop()
            best = self.winner(words[lo:hi])
            if best:
                share, size, a, z, edits, name = best
                out.append((share, size, lo + a, lo + z, edits, name))
                todo += [(lo, lo + a), (lo + z, hi)]
        return out


def apart(found: Sequence[tuple]) -> list[tuple]:
    """The notices that stay where some overlap, in order of their place."""
    kept: list[tuple] = []
    for x in sorted(set(found)):
        if all(x[3] <= y[2] or y[3] <= x[2] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[2])


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES) -> DataFrame:
    """(id, notices) of every row: each notice with its license, first word, last word + 1, and number of words that differ."""
    id_type = docs.schema[id_col].dataType.simpleString()
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("differences", pa.int64())]))
        for b in batches:
            schema = pa.schema([(id_col, b.schema.field(0).type), ("notices", kind)])
            for lo, hi, data, at in T.blocks(b.column(1)):
                d = _Docs(data, at)
                found: list[list[tuple]] = [[] for _ in range(hi - lo)]
                for a, z in scanner.blocks(d):
                    t = int(d.text[a])
                    base = a - int(d.first[t])
                    words = [d.raw[d.starts[k] : d.ends[k]] for k in range(a, z)]
                    found[t] += [(share, size, base + s, base + e, n, name) for share, size, s, e, n, name in scanner.notices(words)]
                notices = [[{"license": name, "start": s, "end": e, "differences": n} for _, _, s, e, n, name in apart(own)] for own in found]
                yield batch(schema, b.column(0).slice(lo, hi - lo), notices)

    columns = f"{quoted(id_col)} {id_type}, notices array<struct<license: string, start: long, `end`: long, differences: long>>"
    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(lean(run), columns)
