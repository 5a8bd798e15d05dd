"""License scans: MinHash bands over text windows retrieve templates, exact shingle containment verifies them.

Templates of about one length share windows of that many shingles plus the step between windows, so every occurrence lies
whole in some window. An occurrence that holds CONTAINMENT of a template's shingles then has at least a known similarity to
that window, and the number of bands is the smallest at which such a window is missed with probability MISS at most.
Windows that hold no template shingle cannot collide and are skipped. A retrieved window is verified on the exact shingles
from its start to its end; overlapping matches of a template count once, the fullest (then first) one stays.

Words: A-Z lower-cased, runs of letters, digits and non-ASCII characters. Shingles have five words; a template of fewer
words is one shingle of its length. Null and empty texts match nothing. Repeated rows, and rows with null ids, are scanned
like others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.license_texts import LICENSES, NOTICES

WIDTH, CONTAINMENT, MISS, ROWS = 5, 0.8, 1e-4, 2
TEMPLATES = NOTICES | LICENSES
_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more entry than texts)."""
    split = [t.encode("utf-8", "surrogatepass").translate(_KEEP).split() if t else [] for t in texts]
    flat = np.empty(sum(map(len, split)), object)
    flat[:] = [w for ws in split for w in ws]
    return (pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)), np.r_[0, np.cumsum([len(ws) for ws in split])].astype(np.int64)


def shingled(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for k in range(width):
            x = _mix(x * _A + words[k : k + n])
    return x


def step_of(size: int) -> int:
    return max(1, size // 8)


def similarity(size: int, containment: float) -> float:
    """The least similarity of a template of that many shingles to the window around an occurrence."""
    held = ceil(containment * size)
    return held / (size + step_of(size) - 1 + size - held)


def bands(size: int, containment: float, miss: float = MISS, rows: int = ROWS) -> int:
    """The fewest bands of that many rows at which the window is missed with probability `miss` at most."""
    s = similarity(size, containment) ** rows
    return 1 if s >= 1 else ceil(log(miss) / log(1 - s))


def _bands_of(minima: np.ndarray, rows: int) -> np.ndarray:
    """minima: windows x (bands * rows) -> keys: windows x bands."""
    x = minima.reshape(len(minima), -1, rows)
    key = np.broadcast_to(np.arange(x.shape[1], dtype=np.uint64), x.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = _mix(key * _A + x[:, :, r])
    return key


def _minhashes(shingles: np.ndarray, size: int, step: int, n_hash: int) -> np.ndarray:
    """Minima of windows of `size` shingles, a window every `step`; the last window ends with the text."""
    n = len(shingles)
    starts = np.arange(0, max(n - size, 0) + step, step)
    starts = starts[starts < n]
    out = np.empty((len(starts), n_hash), np.uint64)
    for k in range(n_hash):
        with np.errstate(over="ignore"):
            h = _mix(shingles ^ (_A * np.uint64(2 * k + 1)))
        if size > 1:
            padded = np.r_[h, np.full(size, np.uint64(2**64 - 1))]
            h = np.lib.stride_tricks.sliding_window_view(padded, size)[starts].min(1)
        else:
            h = h[starts]
        out[:, k] = h
    return out


class Templates:
    """Templates by shingle width and size, with the keys of their bands."""

    def __init__(self, texts: Mapping[str, str], containment: float = CONTAINMENT, miss: float = MISS):
        self.containment, self.classes = containment, {}
        for name, text in sorted(texts.items()):
            words, _ = word_hashes([text])
            if not len(words):
                continue
            width = min(WIDTH, len(words))
            own = shingled(words, width)
            self.classes.setdefault((width, len(own)), []).append((name, np.unique(own)))
        self.keys = {}
        for (width, size), members in self.classes.items():
            n = bands(size, containment, miss)
            keys: dict = {}
            for i, (_, own) in enumerate(members):
                with np.errstate(over="ignore"):
                    minima = np.array([[_mix(own ^ (_A * np.uint64(2 * k + 1))).min() for k in range(n * ROWS)]], np.uint64)
                for key in _bands_of(minima, ROWS)[0].tolist():
                    keys.setdefault(key, []).append(i)
            self.keys[width, size] = (n, np.array(sorted(keys), np.uint64), keys)
        self.all = {w: np.unique(np.concatenate([own for (width, _), ms in self.classes.items() if width == w for _, own in ms])) for w in {w for w, _ in self.classes}}

    def scan(self, words: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(name, first word, end word, containment) of one text."""
        found: dict[str, list] = {}
        for width, every in self.all.items():
            sh = shingled(words, width)
            if not len(sh) or not np.isin(sh, every).any():
                continue
            for (w, size), members in self.classes.items():
                if w != width:
                    continue
                step = step_of(size)
                span = size + step - 1
                n, known, keys = self.keys[w, size]
                at = _bands_of(_minhashes(sh, span, step, n * ROWS), ROWS)
                hit = np.isin(at, known)
                for k in np.flatnonzero(hit.any(1)).tolist():
                    low = k * step
                    part = sh[low : low + span]
                    for i in sorted({i for key in at[k][hit[k]].tolist() for i in keys[key]}):
                        name, own = members[i]
                        inside = np.isin(part, own)
                        share = len(np.unique(part[inside])) / len(own)
                        if share >= self.containment:
                            places = np.flatnonzero(inside)
                            found.setdefault(name, []).append((low + int(places[0]), low + int(places[-1]) + width, share))
        out = []
        for name, places in found.items():
            taken: list = []
            for start, end, share in sorted(places, key=lambda p: (-p[2], p[0], p[1])):
                if all(end <= a or b <= start for a, b, _ in taken):
                    taken.append((start, end, share))
            out += [(name, a, b, s) for a, b, s in sorted(taken)]
        return out


def _run(templates: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                words, at = word_hashes(b.column(1).to_pylist())
                # texts without any template shingle are most; one look over the whole batch finds the others
                some = np.zeros(b.num_rows, bool)
                for width, every in templates.all.items():
                    hit = np.flatnonzero(np.isin(shingled(words, width), every))
                    some[np.searchsorted(at, hit, "right") - 1] = True
                rows = [(doc, *m) for i, doc in enumerate(b.column(0).to_pylist()) if some[i] for m in templates.scan(words[at[i] : at[i + 1]])]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "license", "start_word", "end_word", "containment"])

    return run


def templates_of(table: DataFrame) -> dict[str, str]:
    """Templates from a table(name, text), for scan(). A reference list: it is read on the driver and sent to every task."""
    return {r.name: r.text for r in table.where("name is not null and text is not null").select("name", "text").collect()}


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """A row for each match: doc_id, license, start_word, end_word (exclusive), containment."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_run(Templates(templates, containment, miss)), "doc_id long, license string, start_word long, end_word long, containment double")
