"""Statistics of whole texts that rules and classifiers share."""

from __future__ import annotations

from collections import Counter

import numpy as np

SYMBOLS = b"#*$%&|<>"
#: Byte classes counted by ``byte_profile``: fixed values.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": SYMBOLS, "stop": b".!?", "comma": b",;:", "loud": b"!", "pipe": b"|", "bracket": b"{}[]()<>", "slash": b"/\\_=@"}
_TABLE = np.zeros((len(CLASSES) + 2, 256), np.int64)
for _i, _c in enumerate(CLASSES.values()):
    _TABLE[_i, list(_c)] = 1
_TABLE[-2, 128:] = 1
_TABLE[-1, 0x80:0xC0] = 1


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text.

    Words are runs of bytes other than space and the ASCII control spaces.
    Repeated words are those inside a window of three words that occurs twice
    or more in the text, its first occurrence included. Null counts as empty.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    bytes_of = np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
    chars = int(bytes_of.sum() - _TABLE[-1] @ bytes_of)
    symbols = sum(raw.count(x) for x in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    if n < 3:
        return n, chars, symbols, dup, 0
    return n, chars, symbols, dup, repeated_in_windows(words)


def repeated_in_windows(words: list[bytes], size: int = 3) -> int:
    """How many words lie in a window of ``size`` words that occurs more than once."""
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n = len(words) - size + 1
    if len(ids) < 2**20:
        window = code[:n] * len(ids) ** 2 + code[1 : n + 1] * len(ids) + code[2 : n + 2]
    else:
        window = np.unique(np.stack([code[i : n + i] for i in range(size)], 1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(window, kind="stable")
    s = window[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    if not len(same):
        return 0
    hit = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.concatenate([order[same], order[same + 1]]))
    np.add.at(hit, at, 1)
    np.add.at(hit, at + size, -1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


#: Inputs of the learned scorers, in order.
FEATURES = (
    "log_words", "chars_per_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "longest_word", "top_word_rate", "words_per_line", "short_line_rate", "line_spread",
    *(f"{c}_rate" for c in CLASSES), "foreign_rate", "one_letter_rate", "long_word_rate", "stops_per_line", "capital_word_rate", "log_lines", "common_rate",
)


def profile(text: str | None, counts: tuple[int, int, int, int, int] | None = None) -> list[float]:
    """``FEATURES`` of a whole text; a text without words gives zeros."""
    n, chars, symbols, dup, repeat = counts or rule_counts(text)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    size = np.fromiter(map(len, words), np.int64, n)
    per_line = np.fromiter((x.count(b" ") + 1 for x in lines), np.int64, len(lines))
    counted = Counter(words)
    top = counted.most_common(10)
    classes = _TABLE @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    capital = sum(1 for w in words if 65 <= w[0] <= 90)
    return [
        float(np.log1p(n)), chars / n, symbols / n, dup / len(lines), repeat / n, len(counted) / n, float(min(size.max(), 200)), top[0][1] / n, n / len(lines), float((per_line < 4).mean()), float(per_line.std() / (per_line.mean() + 1)),
        *classes[:-1].tolist(), float((size == 1).mean()), float((size > 14).mean()), (raw.count(b".") + raw.count(b"!") + raw.count(b"?")) / len(lines), capital / n, float(np.log1p(len(lines))), sum(c for _, c in top) / n,
    ]
