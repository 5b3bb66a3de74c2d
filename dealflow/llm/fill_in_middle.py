"""Fill-in-middle transformation over a wavelet matrix of character classes (operator 12).

Texts are cut between units: a run of letters A-Z, a-z is one unit, every other character is one.
Each character has a class (inside a run of letters, first letter of a run, white space, other),
and the classes of a batch of texts make one wavelet matrix of two planes. A unit starts at every
character of the classes in ``UNIT_STARTS``, so the units before a position are the sum of the
ranks of those classes, and the place of a cut is found by bisection on that sum, for all texts of
the batch at once.

The cuts, and the form of the output (plain, prefix-suffix-middle or suffix-prefix-middle), come
from the SHA-256 of seed and id: reruns agree, and rows of one id share their numbers, but not
their cuts. A null id is hashed as the empty string. Null and empty texts, and texts that contain
a sentinel, stay plain; a plain output of a null text is empty. A very long text is a batch of its
own. Every row has a result; an empty table gives none; no column but doc_id and text is read.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import groups
from dealflow.llm.wavelet import WaveletMatrix

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Seed, per cent of texts transformed, per cent of those in suffix-prefix-middle form.
SEED, RATE, SPM = 1, 90, 20
INSIDE, FIRST, SPACE, OTHER = range(4)
#: Classes whose characters start a unit.
UNIT_STARTS = (FIRST, SPACE, OTHER)
#: Characters of the texts that share a wavelet matrix (or one longer text).
BATCH_CHARS = 1 << 21


def classes(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The class of every code point; texts begin at ``begins``."""
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    after = np.concatenate([[False], letter[:-1]])
    after[begins[begins < len(points)]] = False
    space = (points == 32) | (points >= 9) & (points <= 13)
    return np.where(letter, np.where(after, INSIDE, FIRST), np.where(space, SPACE, OTHER)).astype(np.uint8)


def units_before(matrix: WaveletMatrix, at: np.ndarray) -> np.ndarray:
    """Units that start before each position: the ranks of the starting classes together."""
    return sum(matrix.rank(c, at) for c in UNIT_STARTS)


def cut_at(matrix: WaveletMatrix, begins: np.ndarray, ends: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Per text the position behind its first ``units`` units, by bisection on the ranks."""
    goal, lo, hi = units_before(matrix, begins) + units, begins, ends
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        over = units_before(matrix, np.minimum(mid + 1, matrix.n)) > goal  # the next unit has started at mid
        lo, hi = np.where(open_ & ~over, mid + 1, lo), np.where(open_ & over, mid, hi)
    return lo


def numbers(doc_id: object, seed: int) -> list[int]:
    """The first four 8-digit groups of the hash of a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(ids: list, texts: list[str], seed: int = SEED, rate: int = RATE, spm: int = SPM,
              sentinels: tuple[str, str, str] = SENTINELS) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    p, s, m = sentinels
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    matrix = WaveletMatrix.build(classes(points, begins), 2)
    n = units_before(matrix, ends) - units_before(matrix, begins)
    h = np.array([numbers(i, seed) for i in ids], np.int64)
    picks = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    first, second = (cut_at(matrix, begins, ends, picks[:, k]) - begins for k in (0, 1))
    out = []
    for k, t in enumerate(texts):
        a, b = int(first[k]), int(second[k])
        if not t or any(x in t for x in sentinels) or h[k, 2] % 100 >= rate:
            out.append((int(n[k]), "plain", None, None, t))
        elif h[k, 3] % 100 < spm:
            out.append((int(n[k]), "spm", a, b - a, f"{s}{t[b:]}{p}{t[:a]}{m}{t[a:b]}"))
        else:
            out.append((int(n[k]), "psm", a, b - a, f"{p}{t[:a]}{s}{t[b:]}{m}{t[a:b]}"))
    return out


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM,
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n (units), form, prefix_chars, middle_chars (null
    where plain), output."""
    if any(a[-k:] == b[:k] for a in sentinels for b in sentinels for k in range(1, min(len(a), len(b)))) \
            or any(a in b for a, b in permutations(sentinels, 2)):
        raise ValueError("sentinels must be three different strings that cannot overlap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in groups(map(len, texts), BATCH_CHARS):
                rows = batch.slice(part.start, part.stop - part.start)
                done = transform(rows.column("doc_id").to_pylist(), texts[part], seed, rate, spm, sentinels)
                columns = [pa.array(c, kind) for c, kind in zip(zip(*done, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names=names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from the output and its form alone."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)))
    prefix, suffix = (F.when(form == "psm", parts[a]).otherwise(parts[b]) for a, b in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))
