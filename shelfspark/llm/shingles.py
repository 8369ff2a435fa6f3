"""Word-shingle sets of whole texts as sorted 64-bit hashes, in numpy.

Only A-Z are lower-cased; words are separated by blanks, tabs, line feeds,
vertical tabs, form feeds and returns. A text with fewer words than a shingle
is one shingle; a text without words has none.

A word's hash is a cryptographic one (of 64 bits), so no two words can be made
to agree by their letters; a shingle mixes the hashes of its words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute

BATCH_BYTES = 1_000_000
SHINGLED_BYTES = 4_000_000  # more of a batch's words are equal the larger it is

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
        0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
_BASE = 0x5851F42D4C957F2D

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, "uint64")
    out[0] = 1
    return np.cumprod(out, dtype="uint64")


def batches(texts: Iterator[bytes], size: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """Texts in lists of about ``size`` bytes; one text alone may be larger."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t) + 1
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _hashed_words(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of every text, and the hashes of all words. Equal words of
    the batch are hashed once."""
    lower = pa.array([t.translate(_LOWER) for t in part], pa.large_binary()).cast(pa.large_string())
    # Arrow's blanks are exactly the six separators; texts that begin or end in one have empty parts
    found = pa.compute.ascii_split_whitespace(lower)
    some = found.flatten()
    real = pa.compute.binary_length(some).to_numpy() > 0
    per_doc = np.bincount(pa.compute.list_parent_indices(found).to_numpy()[real], minlength=len(part))
    coded = some.dictionary_encode()
    known = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in known]), "<u8")
    return per_doc, hashes[coded.indices.to_numpy()[real]]


def shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of every text, in lists of a bounded number of bytes of text."""
    for part in batches(((t or "").encode("utf-8", "replace") for t in texts), SHINGLED_BYTES):
        out: list[np.ndarray] = []
        per_doc, word = _hashed_words(part)
        first = np.concatenate([[0], np.cumsum(per_doc)])
        n = max(len(word) - words + 1, 0)
        whole = np.zeros(n, "uint64")
        for j in range(words):
            whole += word[j:j + n] * np.uint64(_ODD[j])
        whole = mix(whole)
        for i in range(len(part)):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= words:
                some = np.sort(whole[a:b - words + 1])
                out.append(some[np.concatenate([[True], some[1:] != some[:-1]])])
            elif b > a:
                few = (word[a:b] * np.array(_ODD[:b - a], "uint64")).sum(dtype="uint64") + np.uint64(b - a)
                out.append(mix(np.array([few], "uint64")))
            else:
                out.append(np.zeros(0, "uint64"))
        yield out


def set_ids(sets: list[np.ndarray]) -> list[int | None]:
    """``set_id`` of every set, null for empty ones."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if not len(full):
        return [None] * len(sets)
    first = np.cumsum(sizes) - sizes
    total = np.add.reduceat(mix(np.concatenate(sets) + np.uint64(_ODD[-1])), first[full]) + sizes[full].astype("uint64")
    out: list[int | None] = [None] * len(sets)
    for i, h in zip(full.tolist(), mix(total).view("int64").tolist()):
        out[i] = h
    return out


def set_id(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a whole set."""
    total = mix(shingles + np.uint64(_ODD[-1])).sum(dtype="uint64") + np.uint64(len(shingles))
    return int(mix(np.array([total], "uint64")).view("int64")[0])
