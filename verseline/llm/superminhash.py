"""SuperMinHash signatures, computed for many sets at once.

Each element walks a random permutation of the signature's slots; at step j it
offers slot p[j] the value j + r_j.  As step j only offers values of j or more,
a set whose slots all hold less than j is done: on large sets two or three
steps are enough, where plain MinHash takes as many hashes as there are slots.
Slots of one signature are correlated so that the estimate's variance is below
plain MinHash's.
"""

from __future__ import annotations

import numpy as np

from verseline.llm.text_scan import mix64

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0x632BE59BD9B4E019)
_LOW = np.uint64(0xFFFFFFFF)
#: bits of r; the step is kept above them
_BITS = 24
ELEMENTS = 60_000


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """uint32 matrix (sets, slots); the row of an empty set is all ones."""
    if not 1 <= slots <= 256:
        raise ValueError("slots must be 1 to 256")
    out = np.full((len(sets), slots), 0xFFFFFFFF, np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    lo = 0
    while lo < len(sets):
        hi, held = lo, 0
        while hi < len(sets) and (hi == lo or held + sizes[hi] <= ELEMENTS):
            held += sizes[hi]
            hi += 1
        if held:
            _fill(out[lo:hi], sets[lo:hi], sizes[lo:hi])
        lo = hi
    return out


def _fill(out: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray) -> None:
    slots = out.shape[1]
    flat = out.reshape(-1)
    elem = mix64(np.concatenate(sets) ^ _SALT)
    owner = np.repeat(np.arange(len(sets)), sizes)
    perm = np.tile(np.arange(slots, dtype=np.uint8), (len(elem), 1))
    row = np.arange(len(elem))
    for j in range(slots):
        rnd = mix64(elem + np.uint64((int(_STEP) * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = (((rnd & _LOW) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64) + j
        slot = perm[row, at]
        perm[row, at] = perm[row, j]
        value = (rnd >> np.uint64(64 - _BITS)).astype(np.uint32) | np.uint32(j << _BITS)
        np.minimum.at(flat, owner * slots + slot, value)
        open_set = (out.max(axis=1) >> _BITS) > j
        keep = open_set[owner]
        if not keep.all():
            elem, owner, row = elem[keep], owner[keep], row[keep]
            if not len(elem):
                return


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for every ``rows`` slots of each signature; the band's number is part of the key."""
    n, slots = signature.shape
    count = slots // rows
    part = signature[:, : count * rows].reshape(n, count, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * _STEP, (n, count)).copy()
    for i in range(rows):
        key = mix64(key + part[:, :, i] * _SALT)
    return key
