"""Base spans and the semi-Markov conditional random field of the personal-data
finder, for one text or one batch of islands at a time."""

from __future__ import annotations

import re

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment and of an island's padded table at most.
MAX_TOKENS, FIT_TOKENS = 16, 40
#: Hash buckets for the lengths of digit groups.
SHAPES = 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs from a run's first digit on: a shorter run or a later start could not match either.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rule-made spans, sorted; linear in the text."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        end = m.end() if m else at + 1
        if m:
            out.append((start, 0, end))
        at = text.find("@", end)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _only_digits(m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# --- islands: where a span can be ------------------------------------------------

#: A word that holds a digit or an at sign, also spelled "(at)" or "[at]".
_HOT = r"(?:[^\s0-9@]*+[0-9@]\S*+|\S{0,40}?(?:\(at\)|\[at\])\S*+)"
_ISLAND = re.compile(rf"(?<!\S){_HOT}(?:[ \t]{_HOT})*+")
_ANCHOR = re.compile(r"[0-9@]|\(at\)|\[at\]")
_BEFORE, _AFTER = re.compile(r"\S{1,40}[ \t]?\Z"), re.compile(r"[ \t]\S{1,40}")
_TOKEN = re.compile(r"\(at\)|\[at\]|[^\W_]+|[\s\S]")


def islands(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of hot words, with a neighbouring word on either side."""
    if not _ANCHOR.search(text):
        return []
    out = []
    for m in _ISLAND.finditer(text):
        before = _BEFORE.search(text, max(0, m.start() - 41), m.start())
        after = _AFTER.match(text, m.end())
        start = before.start() if before and text[m.start() - 1:m.start()] in (" ", "\t") else m.start()
        out.append((start, after.end() if after else m.end()))
    return out


def tokens(text: str, start: int, end: int) -> list[int]:
    """Where tokens begin, and the end."""
    return [m.start() for m in _TOKEN.finditer(text, start, end)] + [end]


# --- whole-span features -----------------------------------------------------------

#: Words before a span that name its kind. Fixed values.
CUES = {"email": 0, "mail": 0, "e-mail": 0, "mailto": 0, "contact": 0,
        "ip": 1, "host": 1, "server": 1, "address": 1,
        "card": 2, "visa": 2, "mastercard": 2, "credit": 2, "cc": 2,
        "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3, "cell": 3}
_COUNTS = (0, 4, 7, 9, 10, 11, 12, 13, 16, 17, 20)      # lower edges of digit-count classes
_FLAGS = ("bias", "luhn", "luhn_fails", "plus", "paren", "paren_open", "hyphen", "dot", "two_dots", "three_dots", "more_dots",
          "space", "slash_colon", "comma", "at", "at_spelled", "more_at", "letters", "letters_no_at", "other", "quad", "quad_over", "tld",
          "local_ok", "long_group", "even_groups", "left_alnum", "left_mark", "right_alnum", "right_mark", "digits_only")
N_FEATURES = len(_FLAGS) + len(_COUNTS) + SHAPES + len(KINDS)
_F = {name: k for k, name in enumerate(_FLAGS)}
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}\Z")
_SPELLED = re.compile(r"\(at\)|\[at\]")


def candidate(text: str, start: int, end: int) -> bool:
    """Whether a segment can be an entity at all: an anchor inside, word
    characters at its ends, digits of a plausible number or an address."""
    first, last = text[start], text[end - 1]
    if not (first.isalnum() or first in "+(") or not last.isalnum():
        return False
    s = text[start:end]
    if "@" in s or "at" in s and _SPELLED.search(s):
        return True
    n = sum("0" <= c <= "9" for c in s)
    return 4 <= n <= 20 and not any(c.isalpha() for c in s)


def features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features that hold for the whole segment."""
    s = text[start:end]
    digits = _only_digits(s)
    f = [_F["bias"], len(_FLAGS) + sum(len(digits) >= c for c in _COUNTS[1:])]
    add = lambda name, holds: holds and f.append(_F[name])
    at = s.count("@")
    spelled = len(_SPELLED.findall(s))
    letters = any(c.isalpha() for c in s)
    if 12 <= len(digits) <= 19 and not letters:
        f.append(_F["luhn" if luhn(digits) else "luhn_fails"])
    add("plus", s[0] == "+")
    add("paren", "(" in s and ")" in s and not spelled)
    add("paren_open", s.count("(") != s.count(")"))
    add("hyphen", "-" in s)
    dots = s.count(".")
    f.extend([[], [_F["dot"]], [_F["two_dots"]], [_F["three_dots"]]][dots] if dots < 4 else [_F["more_dots"]])
    add("space", " " in s or "\t" in s)
    add("slash_colon", "/" in s or ":" in s)
    add("comma", "," in s)
    add("at", at == 1)
    add("at_spelled", spelled == 1)
    add("more_at", at + spelled > 1)
    add("letters", letters)
    add("letters_no_at", letters and at + spelled == 0)
    add("other", any(not (c.isalnum() or c in " \t+().-@_%[]") for c in s))
    if dots == 3 and not letters and re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", s):
        f.append(_F["quad" if all(len(p) < 4 and int(p) < 256 for p in s.split(".")) else "quad_over"])
    if at + spelled == 1:
        mail = _MAIL.match(s) is not None
        add("tld", mail)
        add("local_ok", mail)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    if groups and not letters:
        add("long_group", max(groups) > 4)
        add("even_groups", len(groups) > 1 and len(set(groups)) == 1)
        add("digits_only", len(digits) == len(s))
        h = 0
        for g in groups[:8]:
            h = (h * 31 + min(g, 9) + 1) % 1_000_003
        f.append(len(_FLAGS) + len(_COUNTS) + h % SHAPES)
    left, right = text[start - 1:start], text[end:end + 1]
    add("left_alnum", left.isalnum())
    add("left_mark", bool(left) and not left.isalnum() and not left.isspace())
    add("right_alnum", right.isalnum())
    add("right_mark", bool(right) and not right.isalnum() and not right.isspace())
    cue = re.search(r"([^\W_]+(?:-[^\W_]+)?)[:.=]?\s?\Z", text[max(0, start - 24):start])
    if cue and (k := CUES.get(cue.group(1).lower())) is not None:
        f.append(len(_FLAGS) + len(_COUNTS) + SHAPES + k)
    return f


def segments(text: str, start: int, end: int, positions: list[int] | None = None) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """An island's token positions and its candidate segments (first token, number of tokens, features)."""
    at = positions or tokens(text, start, end)
    out = []
    for i in range(len(at) - 1):
        if not (text[at[i]].isalnum() or text[at[i]] in "+("):
            continue
        for d in range(1, min(MAX_TOKENS, len(at) - 1 - i) + 1):
            if candidate(text, at[i], at[i + d]):
                out.append((i, d, features(text, at[i], at[i + d])))
    return at, out


# --- the model ---------------------------------------------------------------------

def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(a, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def decode(n: int, found: list[tuple[int, int, list[int]]], weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(first token, tokens, kind, posterior) of the best segmentation of an island
    of ``n`` tokens. Outside tokens are segments of one with score 0; an entity has ``MAX_TOKENS`` at most, so
    the dynamic program looks back that far and no further."""
    ending: dict[int, list[tuple[int, np.ndarray]]] = {}
    starting: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, d, f in found:
        scores = weights[f].sum(axis=0)
        ending.setdefault(i + d, []).append((i, scores))
        starting.setdefault(i, []).append((i + d, scores))
    best, forward, back = np.zeros(n + 1), np.zeros(n + 1), [None] * (n + 1)
    for t in range(1, n + 1):
        best[t], total = best[t - 1], [forward[t - 1]]
        for i, scores in ending.get(t, ()):
            k = int(scores.argmax())
            total.extend(forward[i] + scores)
            if best[i] + scores[k] > best[t]:
                best[t], back[t] = best[i] + scores[k], (i, k, scores[k])
        forward[t] = total[0] if len(total) == 1 else np.logaddexp.reduce(total)
    backward = np.zeros(n + 1)
    for t in range(n - 1, -1, -1):
        total = [backward[t + 1]]
        for j, scores in starting.get(t, ()):
            total.extend(backward[j] + scores)
        backward[t] = total[0] if len(total) == 1 else np.logaddexp.reduce(total)
    out, t = [], n
    while t > 0:
        if back[t] is None:
            t -= 1
            continue
        i, k, score = back[t]
        out.append((i, t - i, k, float(np.exp(forward[i] + score + backward[t] - forward[n]))))
        t = i
    return out[::-1]


def fit(islands_: list[tuple[int, list[tuple[int, int, list[int]]], dict[tuple[int, int], int]]], steps: int = 100, rate: float = 0.2,
        penalty: float = 1.0) -> np.ndarray:
    """Weights (feature x kind) of greatest penalised conditional likelihood, by Adam over all islands at once.

    Each island: number of tokens (``FIT_TOKENS`` at most), candidate segments, gold segments {(first, tokens): kind}."""
    weights = np.zeros((N_FEATURES, len(KINDS)))
    if not islands_:
        return weights
    count, length = len(islands_), max(n for n, _, _ in islands_)
    rows, where, gold = [], [], []
    for k, (_, found, labels) in enumerate(islands_):
        for i, d, f in found:
            x = np.zeros(N_FEATURES)
            x[f] = 1
            rows.append(x)
            where.append((k, i, d - 1))
            gold.append(labels.get((i, d), -1))
    x, where, gold = np.array(rows), np.array(where), np.array(gold)
    hit = np.flatnonzero(gold >= 0)
    observed = np.zeros_like(weights)
    np.add.at(observed.T, gold[hit], x[hit])
    island, first, d = where.T
    m1, m2 = np.zeros_like(weights), np.zeros_like(weights)
    # by token, length and island: segments that are no candidates cannot be taken, padded tokens stay outside
    table = np.full((length + 1, MAX_TOKENS, count), -np.inf)
    for step in range(1, steps + 1):
        scores = x @ weights
        table[first, d, island] = _logsumexp(scores, axis=1)
        forward, backward = np.zeros((length + 1, count)), np.zeros((length + 1, count))
        for t in range(1, length + 1):
            ways = min(MAX_TOKENS, t)
            starts = np.arange(t - 1, t - 1 - ways, -1)
            forward[t] = _logsumexp(np.concatenate([forward[t - 1:t], forward[starts] + table[starts, np.arange(ways)]]), axis=0)
        for t in range(length - 1, -1, -1):
            ways = min(MAX_TOKENS, length - t)
            backward[t] = _logsumexp(np.concatenate([backward[t + 1:t + 2], backward[t + 1:t + 1 + ways] + table[t, :ways]]), axis=0)
        expected = np.exp((forward[first, island] + backward[first + d + 1, island] - forward[length, island])[:, None] + scores)
        gradient = (observed - x.T @ expected - penalty * weights) / count
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient ** 2
        weights += rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return weights
