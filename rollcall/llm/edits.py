"""Edit distance by Myers' bit-parallel recurrence; a column of the table is two integers of any length."""

from __future__ import annotations


def _masks(pattern) -> dict:
    masks: dict = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    return masks


def _last_row(pattern, text, anywhere: bool):
    """Distance of the pattern to the best end at each place of the text (anywhere: it may start at any place)."""
    m = len(pattern)
    masks, full, top = _masks(pattern), (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    carry = 0 if anywhere else 1
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & full
        right_up, right_down = (down | ~(d | up)) & full, up & d
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up, right_down = ((right_up << 1) | carry) & full, (right_down << 1) & full
        up, down = (right_down | ~(d | right_up)) & full, right_up & d
        yield score


def distance(a, b) -> int:
    """Levenshtein distance of two strings or byte strings."""
    if not a or not b:
        return len(a) or len(b)
    score = 0
    for score in _last_row(a, b, False):
        pass
    return score


def best_match(pattern, text) -> int:
    """Smallest distance of the pattern to any part of the text, also the empty one."""
    return min(len(pattern), min(_last_row(pattern, text, True), default=len(pattern))) if pattern else 0
