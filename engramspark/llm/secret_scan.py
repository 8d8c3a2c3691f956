"""Secrets: Aho-Corasick keywords, regular expressions anchored at their hits, checksums inside tokens."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import ship

#: In the order that breaks ties between spans with one start.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
HEX_RUN = re.compile(rb"h{3,}")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT_PART = re.compile(rb"[A-Za-z0-9_-]+")
JWT_REST = re.compile(rb"\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access"} | {f"gh{x}_": "github" for x in "pousr"} | {"npm_": "npm", "eyj": "jwt"}
#: Characters of a signed token's first part at most; longer ones are no header.
HEADER = 4096
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_DIGITS = bytes(ord("h") if c in b"0123456789abcdef" else 0x20 for c in range(256))
STRIDE = 8


@lru_cache(None)
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(width, "0")


def checksum_holds(body: bytes, check: bytes) -> bool:
    """The last six characters are the CRC-32 of those before, in base 62."""
    return base62(zlib.crc32(body)) == check.decode()


def is_header(part: bytes) -> bool:
    """Whether this is JSON, in base 64, that names an algorithm."""
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, TypeError, RecursionError):  # no base 64, no UTF-8, no JSON, no container, or too deep
        return False


ANCHORED = {"assign": (ASSIGN, lambda m: len(m[2]) >= 6), "access": (ACCESS, lambda m: len(m[0]) >= 20), "github": (GITHUB, lambda m: checksum_holds(m[1], m[2])), "npm": (NPM, lambda m: checksum_holds(m[1], m[2]))}


def signed_tokens(raw: bytes, hits: list[int]) -> list[tuple[int, int]]:
    """Signed web tokens whose first part begins at one of hits, ascending. What follows a run of token characters is looked at once a run,
    so the work is linear, whatever the number of hits in one run."""
    out, run_end, rest, done = [], 0, None, 0
    for start in hits:
        if start < done:
            continue
        if start >= run_end:
            run_end = JWT_PART.match(raw, start).end()
            rest = JWT_REST.match(raw, run_end)
        if rest is None:
            done = run_end
        elif run_end - start <= HEADER and raw[start : start + 3] == b"eyJ" and is_header(raw[start:run_end]):
            out.append((start, rest.end()))
            done = rest.end()
    return out


def hex_spans(raw: bytes) -> list[tuple[int, int]]:
    """Runs of at least 24 hexadecimal digits. Such a run covers three neighbours of each STRIDE-th byte, so that only these are searched."""
    sparse = raw[::STRIDE].translate(HEX_DIGITS)
    out, done = [], 0
    for hit in HEX_RUN.finditer(sparse):
        for inside in range(hit.start() * STRIDE, hit.end() * STRIDE, STRIDE):
            if inside < done:
                continue
            start = inside
            while start and raw[start - 1 : start].translate(HEX_DIGITS) == b"h":
                start -= 1
            done = HEX.match(raw, inside).end()
            if done - start >= 24:
                out.append((start, done))
    return out


def find(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes; for each kind leftmost, without overlaps."""
    spans = [(start, end, "hex") for start, end in hex_spans(raw)]
    done: dict[str, int] = {}
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in _automaton().iter(raw.lower().decode("latin-1")))
    spans += [(start, end, "jwt") for start, end in signed_tokens(raw, [at for at, kind in hits if kind == "jwt"])]
    for start, kind in hits:
        if kind == "jwt" or start < done.get(kind, 0):
            continue
        pattern, holds = ANCHORED[kind]
        if m := pattern.match(raw, start):
            done[kind] = m.end()
            if holds(m):
                spans.append((start, m.end(), kind))
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


@W.frugal
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        raw, offs = W.utf8(batch.column(1))
        counts = np.zeros((3, len(batch)), np.int64)
        digests, joined, added = [nothing] * len(batch), [""] * len(batch), np.zeros(len(batch), np.int64)
        for i in range(len(batch)):
            text = raw[offs[i] : offs[i + 1]].tobytes()
            if spans := find(text):
                if not text.isascii():
                    points = np.concatenate([[0], np.cumsum((raw[offs[i] : offs[i + 1]] & 0xC0) != 0x80)])
                    spans = [(int(points[a]), int(points[b]), kind) for a, b, kind in spans]
                said = [(kind, f"{kind}:{a}:{b}") for a, b, kind in spans]
                for j, kind in enumerate(KINDS[:3]):
                    counts[j, i] = sum(k == kind for k, _ in said)
                added[i] = len(said) - counts[:, i].sum()
                digests[i] = hashlib.sha256(",".join(x for k, x in said if k in KINDS[:3]).encode()).hexdigest()
                joined[i] = ",".join(x for _, x in said)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x) for x in counts), pa.array(digests), pa.array(joined), pa.array(added)],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked: a row for each row.

    spans has kind:start:end, comma-joined, by start and then kind, in code points, end exclusive; base_sha256 is the digest of its part of the
    kinds assign, access and hex. n_checked counts the added spans: tokens of two issuers whose last
    six characters are the checksum of the rest, and signed web tokens with a readable header. A span is the whole match, keyword included. Null text is empty:
    no spans and the digest of the empty string. Null doc_id and repeated rows are carried. Empty table: no rows. Other columns are ignored. No shuffle."""
    ship(docs.sparkSession)
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return two.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")
