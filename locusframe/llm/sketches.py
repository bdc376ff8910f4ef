"""Parity sketches of sets: they prove that two sets differ by too much, without the sets."""

from __future__ import annotations

import numpy as np
import pandas as pd


def places(n: int) -> int:
    """Places of the sketch of n hashes, a power of two: 8 to 16 per hash of a small set, 2 to 4 of a large one.

    It never falls with n, and sets whose sizes are at most a third apart are at most one power apart.
    """
    return max(64, 1 << max(min(12, int(8 * n - 1).bit_length()), int(2 * n - 1).bit_length()))


def sketch(h: np.ndarray) -> bytes:
    """Parity of the number of hashes at each of `places(len(h))` places.

    Two sets differ in as many members as their sketches do in bits, at least. A longer sketch is
    folded to a shorter one by exclusive-or of its halves.
    """
    n = places(len(h))
    odd = np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _matrix(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of at least `size` bytes as rows of 64-bit words, folded to that size."""
    raw = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    while raw.shape[1] > size:
        half = raw.shape[1] // 2
        raw = raw[:, :half] ^ raw[:, half:]
    return np.ascontiguousarray(raw).view(np.uint64)


def may_link(nx: np.ndarray, x: list[bytes], ny: np.ndarray, y: list[bytes], part: int, of: int) -> np.ndarray:
    """Whether pairs of sets, of nx and ny members and sketches x and y, can have of * common >= part * union."""
    nx, ny = np.asarray(nx, np.int64), np.asarray(ny, np.int64)
    ok = of * np.minimum(nx, ny) >= part * np.maximum(nx, ny)
    lx, ly = np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, y), np.int64, len(y))
    for a, b in sorted(set(zip(lx[ok].tolist(), ly[ok].tolist()))):
        at = np.flatnonzero(ok & (lx == a) & (ly == b))
        for p in np.array_split(at, max(1, len(at) * min(a, b) // (8 << 20))):
            bits = np.bitwise_count(_matrix([x[i] for i in p], min(a, b)) ^ _matrix([y[i] for i in p], min(a, b))).sum(1, dtype=np.int64)
            ok[p] = (of + part) * bits <= (of - part) * (nx[p] + ny[p])
    return ok


def sketched_pairs(pdf: pd.DataFrame, bounds: np.ndarray, part: int, of: int, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket, in different components, whose sets may link: columns n, comp, sketch.

    With `best`, of each two components only the pair that differs least: most links are among these.
    """
    n, comp, sketches = pdf.n.to_numpy(np.int64), pdf.comp.to_numpy(), list(pdf["sketch"])
    size = np.fromiter(map(len, sketches), np.int64, len(sketches))
    left, right = [], []
    least: dict[tuple[int, int], tuple[float, int, int]] = {}
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo < 2:
            continue
        rows = np.arange(lo, hi)
        for s in np.unique(size[lo:hi]).tolist():
            own = rows[size[lo:hi] == s]
            # Sets of the next size: only these can still link with one of this size.
            both = np.r_[own, rows[size[lo:hi] == 2 * s]]
            if len(both) < 2:
                continue
            own_m = _matrix([sketches[i] for i in own], s)
            more = both[len(own) :]
            m = np.vstack([own_m, _matrix([sketches[i] for i in more], s)]) if len(more) else own_m
            for k, i in enumerate(own.tolist()):
                rest = slice(k + 1, None)
                j = both[rest]
                near = (comp[j] != comp[i]) & (of * np.minimum(n[j], n[i]) >= part * np.maximum(n[j], n[i]))
                if not near.any():
                    continue
                j, other = j[near], m[rest][near]
                bits = np.bitwise_count(other ^ m[k]).sum(1, dtype=np.int64)
                ok = (of + part) * bits <= (of - part) * (n[j] + n[i])
                j, bits = j[ok], bits[ok]
                if best:
                    share = bits / (n[j] + n[i])
                    order = np.lexsort((share, comp[j]))
                    for x in order[np.r_[True, comp[j][order][1:] != comp[j][order][:-1]]].tolist() if len(j) else ():
                        pair = (min(comp[i], comp[j[x]]), max(comp[i], comp[j[x]]))
                        least[pair] = min(least.get(pair, (9.0, 0, 0)), (float(share[x]), i, int(j[x])))
                    continue
                left.append(np.full(len(j), i))
                right.append(j)
    if best:
        found = np.array([x[1:] for x in least.values()], np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2
