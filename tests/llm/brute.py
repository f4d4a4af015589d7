"""Plain single-process versions of the operators, for comparison."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

SPACE = re.compile("[\x20\x09-\x0D]")
_TOK = {}


def tokenizer(name):
    if name not in _TOK:
        from tokenizers import Tokenizer
        _TOK[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _TOK[name]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def token_ids(text, name, end):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids + [end]


def exact_groups(docs):
    """[(doc_id, text)] -> sorted (doc_id, keep_id, group_size, kept, sha)."""
    groups = defaultdict(list)
    for d, t in docs:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), d))
    out = []
    for norm, rows in groups.items():
        rows.sort()
        for k, (_, d) in enumerate(rows):
            out.append((d, rows[0][1], len(rows), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


def tiktoken_encoding():
    if "tik" not in _TOK:
        import tiktoken
        with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _TOK["tik"] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _TOK["tik"]


def simhash(text):
    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs, bits=3):
    fps = [(d, simhash(t)) for d, t in docs]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for k in range(i):
            if bin(fps[i][1] ^ fps[k][1]).count("1") <= bits:
                a, b = find(i), find(k)
                if a != b:
                    root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, f"{fp:016x}", least[find(i)]) for i, (d, fp) in enumerate(fps))


def repeated_bytes(docs, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each (doc_id, text), in their order."""
    seen, out = set(), {}
    for k, (d, t) in sorted(enumerate(docs), key=lambda x: (x[1][0], x[1][1] or "")):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        gone = gone[:-1]
        edges = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[k] = (d, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return sorted(out.values())


def top_k(vectors, k=5, every=50):
    own = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in vectors
           if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in own:
        if q % every == 0:
            found = sorted((-int(x @ y), i) for i, y in own if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)
