"""Brute-force versions of the contracts, and tables with awkward rows."""

import hashlib
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_docs(spark, *texts):
    """Null, empty and blank texts, a null id, repeated rows, a very long text, then ``texts``; ids from 0."""
    rows = [(0, None), (1, ""), (2, " \n\t "), (None, "a row without an id but with some words in it"),
            (4, "one"), (5, "word " * 40_000), (6, "the same row twice, word for word, in one table")]
    rows += [rows[-1]] + [(10 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    # further columns whose names the operators use inside
    return df.selectExpr("*", "'x' AS fingerprint", "'x' AS component_id", "1 AS hash", "2 AS n", "'x' AS key", "'y' AS spans",
                         "3 AS kind", "'z' AS fp", "0 AS length", "0 AS rank", "false AS held_out", "'q' AS base")


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def simhash(text, k=4):
    import numpy as np
    import xxhash
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = np.array([xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def components(fps, bits):
    """id -> smallest reachable id, over all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def removed(rows, width=100):
    """doc_id -> (bytes, removed, spans, digest of the rest), string by string."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            w = data[i:i + width]
            if w in seen:
                gone[i:i + width] = b"\1" * width
            seen.add(w)
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def _joined(spans):
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def secrets(text):
    """(n_assign, n_access, n_hex, base spans as text)."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ["assign", "access", "hex"]
    return tuple(sum(f[1] == k for f in found) for k in range(3)), _joined((names[k], i, j) for i, k, j in sorted(found))


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(digits[::-1])) % 10 == 0


def personal(text):
    def digits(m):
        return re.sub("[^0-9]", "", m)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    found = [(k, m.start(), m.end()) for k, rx, ok in kinds for m in re.finditer(rx, text) if ok(m[0])]
    return tuple(sum(f[0] == k for f in found) for k, _, _ in kinds), _joined(found)
