"""Hashes of words and of word shingles, over whole arrays of bytes."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np

#: Two prime moduli, and for each a base whose powers tell places apart.
_PRIMES = ((2**31 - 1, 1_299_709), ((1 << 31) - 19, 15_485_863))
#: Bytes whose weighted sum stays below 2**64: 2**9 * 2**31 * 2**22.
_MOST_BYTES = 1 << 22
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=8)
def _powers(bits: int, prime: int, base: int) -> np.ndarray:
    """base ** k modulo prime for k below 2 ** bits."""
    out = np.ones(1 << bits, np.uint64)
    for k in range(bits):
        out[1 << k : 2 << k] = out[: 1 << k] * np.uint64(pow(base, 1 << k, prime)) % np.uint64(prime)
    return out


def byte_tables(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(is a separator, value with A-Z lower-cased and never 0) for each byte."""
    apart = np.zeros(256, bool)
    apart[list(separators)] = True
    value = np.arange(1, 257, dtype=np.uint64)
    value[65:91] += np.uint64(32)
    return apart, value


#: Words are runs of anything but space and bytes 9 to 13.
WHITE = byte_tables(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters, digits and bytes of other scripts.
PUNCTUATION = byte_tables(bytes(i for i in range(128) if not chr(i).isalnum()))


def word_hashes(data: np.ndarray, tables: tuple[np.ndarray, np.ndarray] = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of a uint8 array; equal words up to A-Z have equal hashes.

    A hash joins the word's polynomials modulo two primes. Arrays of millions of bytes are worked off in pieces that end
    between words; a word of millions of bytes is hashed by itself.
    """
    apart, value = tables
    edge = np.empty(len(data) + 2, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = apart[data]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = turns[0::2], turns[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + (1 << 18), side="right")))
        low, high = int(start[first]), int(end[last - 1])
        part = value[data[low:high]]
        if high - low > _MOST_BYTES:
            digest = hashlib.blake2b(part.astype("<u2").tobytes(), digest_size=8).digest()
            out[first] = int.from_bytes(digest, "little")
            first = last
            continue
        s, e = start[first:last] - low, end[first:last] - low
        joint = (e - s).astype(np.uint64)
        bits = max(18, int(high - low).bit_length())
        for prime, base in _PRIMES:
            p, power, inverse = np.uint64(prime), _powers(bits, prime, base), _powers(bits, prime, pow(base, -1, prime))
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(part * power[: high - low], out=sums[1:])
            joint = (joint << np.uint64(31)) ^ ((sums[e] - sums[s]) % p * inverse[s] % p)
        out[first:last] = joint
        first = last
    return mix(out), start, end


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the runs of `size` words; of all words if there are fewer; none of none."""
    n = len(words)
    if n == 0:
        return words
    span = min(n, size)
    total = np.full(n - span + 1, np.uint64(span), np.uint64)
    for place in range(span):
        total += words[place : n - span + 1 + place] * _PLACES[place % 5] * np.uint64(2 * (place // 5) + 1)
    return np.unique(mix(total))


_LOWER = bytes(32 if i in b"\t\n\x0b\x0c\r" else i + 32 * (65 <= i <= 90) for i in range(256))
_SPACES = re.compile(b"  +")


def normal_bytes(text: str) -> bytes:
    """A text's words in UTF-8, A-Z lower-cased, with one space between."""
    return _SPACES.sub(b" ", text.encode("utf-8", "surrogatepass").translate(_LOWER)).strip(b" ")


def numbered_shingles(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct numbers of its shingles; two are equal if and only if all their words are: nothing is hashed to a number.

    Words are numbered, then runs of two words, of three and so on.
    """
    known: dict[bytes, int] = {}
    words = []
    for text in texts:
        own = normal_bytes(text).split()
        words.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)))
    flat = np.concatenate([*words, np.zeros(0, np.int64)])
    runs = flat
    for k in range(1, size):
        runs = np.unique(runs[: len(flat) - k] * (len(known) + 1) + flat[k:], return_inverse=True)[1].reshape(-1)
    short: dict[tuple, int] = {}
    out, at = [], 0
    for own in words:
        if len(own) >= size:
            out.append(np.unique(runs[at : at + len(own) - size + 1]))
        else:  # fewer words: the whole sequence, with a number below 0
            out.append(np.array([-1 - short.setdefault(tuple(own.tolist()), len(short))] if len(own) else [], np.int64))
        at += len(own)
    return out
