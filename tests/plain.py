"""Plain Python versions of scans that the library does with column functions, to compare with."""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import numpy as np


def first_json(text: str | None) -> str | None:
    """The leftmost balanced {...} of a text, if it is valid JSON; an unclosed brace is skipped."""
    if text is None:
        return None
    open_at: list[int] = []
    ends: dict[int, int] = {}
    for i, c in enumerate(text):
        if c == "{":
            open_at.append(i)
        elif c == "}" and open_at:
            ends[open_at.pop()] = i
    outer = min(ends, default=None)
    if outer is None:
        return None
    found = text[outer : ends[outer] + 1]
    try:
        json.loads(found)
    except ValueError:
        return None
    return found


def mean(tokens: list[str], logs: list[float]) -> float:
    x = [np.log(p) if p > 0 else p for t, p in zip(tokens, logs, strict=True) if p is not None and t.strip() not in ("<unk>", "", "\\n")]
    return float(np.exp(np.mean(x))) if x else 0.0


def key_confidences(tokens: list[str], logs: list[float], keys: list[str]) -> dict[str, float]:
    """Average of the tokens that follow each ``"key":``, up to the next key that is found or the end; absent: 0."""
    if not tokens:
        return {}
    text = "".join(tokens)
    ends = np.cumsum([len(t) for t in tokens])
    spots = {}
    for k in keys:
        at = text.find(f'"{k}":')
        if at >= 0:
            spots[k] = (at, at + len(k) + 3)
    out = dict.fromkeys(keys, 0.0)
    begins = sorted(a for a, _ in spots.values())
    for k, (at, after) in spots.items():
        first = int(np.searchsorted(ends, after, "left")) + 1
        later = [a for a in begins if a > at]
        last = int(np.searchsorted(ends, later[0], "right")) if later else len(tokens)
        out[k] = mean(tokens[first:last], logs[first:last])
    return out


def label_confidences(tokens: list[str], logs: list[float], label: str, delimiter: str = ";") -> dict[str, float]:
    """Each label of a list starts with the whole average. Each part of the tokens between delimiters (a part begins with its
    delimiter's token) gives its average to the label that shares the longest run of characters with the part's text, as a
    share of the longer one of both; the first of equal labels, and of several parts the last one."""
    labels = [x.strip() for x in label.split(delimiter) if x.strip()]
    out = dict.fromkeys(labels, mean(tokens, logs))
    parts: dict[str, tuple[int, int]] = {}
    text, begin = "", 0
    for i, t in enumerate(tokens):
        if delimiter in t:
            head, *_, tail = t.split(delimiter)
            parts[(text + head).strip()] = begin, i
            text, begin = tail, i
        else:
            text += t
    if text.strip():
        parts[text.strip()] = begin, len(tokens)
    for text, (a, b) in parts.items():
        ratios = {x: SequenceMatcher(None, x, text, autojunk=False).find_longest_match().size / max(len(x), len(text)) for x in out}
        x = max(ratios, key=ratios.get, default=None)
        if x is not None and ratios[x] > 0:
            out[x] = mean(tokens[a:b], logs[a:b])
    return out


def token_marks(pred: list[str], truth: list[str], words: list[str]) -> tuple[int, int, int]:
    """tp, fp, fn over a text's words: a word is marked by the first unused entity word that is in it or that it is in."""

    def marks(own: list[str]) -> list[bool]:
        left, out = list(own), []
        for w in words:
            at = next((i for i, x in enumerate(left) if x in w or w in x), None)
            if at is not None:
                left.pop(at)
            out.append(at is not None)
        return out

    p, t = marks(pred), marks(truth)
    return sum(a and b for a, b in zip(p, t, strict=True)), sum(a and not b for a, b in zip(p, t, strict=True)), sum(b and not a for a, b in zip(p, t, strict=True))
