"""Thresholds of the operators, in seconds unless said otherwise. Each operator takes the values as arguments; these
are the usual ones."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Cut:
    """Automatic and text cuts: pauses, merging of ranges, and what is kept between them."""

    pause: float = 0.4
    silence_merge: float = 0.05
    silence_keep: float = 0.08
    text_merge: float = 0.08
    text_least: float = 0.0
    context: float = 0.0
    tail: float = 1.0
    text_keep_least: float = 0.02


@dataclass(frozen=True)
class Quality:
    """Transcript checks: confidence, gaps and density."""

    low_confidence: float = 0.6
    low_ratio: float = 0.18
    low_count: int = 30
    long_gap: float = 24.0
    window: float = 20.0
    hop: float = 10.0
    least_in_window: int = 4


@dataclass(frozen=True)
class Captions:
    max_words: int = 3
    max_chars: int = 42
    max_gap: float = 0.55
    least: float = 0.12


#: fixed values: hesitations and fillers that automatic cuts remove, and the longer list that the editor marks
FILLERS = ("um", "uh", "uhm", "umm", "hmm", "hm", "ah", "er", "eh", "like", "basically", "literally", "actually", "right", "you know", "i mean", "sort of", "kind of", "so yeah")
EDITOR_FILLERS = (
    "um", "uh", "uhm", "umm", "hmm", "hm", "mm", "ah", "er", "erm", "eh", "huh", "mhm", "like", "basically", "literally", "actually",
    "you know", "i mean", "sort of", "kind of", "right", "okay", "so", "well", "yeah",
)
#: fixed values: words that name no concept
STOP_WORDS = (
    "a an and are as at be but by for from has have i if in into is it its of on or our that the their there this to was we were with "
    "you your about after before during then than"
).split()
