"""Edit commands in plain English, as columns: a prompt becomes an operation, its parameters and a confidence.

The language is a list of phrases: words that are said as they are, alternatives with a bar, words in brackets that may be
left out, and slots in braces that take a value of a kind. A phrase becomes one pattern for the JVM and one column
expression for each of its slots."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import timecode

#: what a slot of each kind takes. Other kinds are the values themselves: a|b as lower-cased text, a/b as true for a
KINDS = {
    "ref": r"\S+", "time": r"\S+", "ratio": r"\d+:\d+", "int": r"\d+", "num": r"\d+(?:\.\d+)?", "signed": r"-?\d+(?:\.\d+)?", "times": r"\d+(?:\.\d+)?(?=x?$)", "list": ".+", "words": ".+?", "quoted": ".+",
}
#: fixed values: the commands, by what they are about: phrase, confidence, operation and what else it sets
PHRASES = [
    # cuts
    ("trim|cut [clip] {clip} [from] {start_sec:time} to|- {end_sec:time}", 0.97, "trim_clip", {}),
    ("split [clip] {clip} [at] {at_sec:time}", 0.97, "split_clip", {}),
    ("delete|remove clip {clip}", 0.97, "delete_clip", {}),
    # order and speed
    ("merge|join|combine clip|clips {clips:list}", 0.97, "merge_clips", {}),
    ("move|shift clip {clip} to|at {timeline_start_sec:time}", 0.97, "move_clip", {"ripple": "false"}),
    ("ripple [edit] {track_kind:video|audio}", 0.97, "ripple_edit", {}),
    ("[set] speed [of] clip {clip} [to] {speed:times}x?", 0.97, "set_speed", {}),
    # transitions
    ("[add] transition [to] clip {clip} {type:fade|dissolve|slide_left|slide_right|slide_up|slide_down|zoom|wipe} {duration_sec:time}", 0.97, "set_transition", {}),
    ("fade {mode:in|out} clip {clip} {duration_sec:time}", 0.97, "set_transition", {"type": "fade"}),
    # pictures
    ("rotate clip {clip} {degrees:90|180|270|0}(?:deg|degree|degrees)?", 0.97, "rotate_clip", {}),
    ("flip clip {clip} {direction:horizontal|vertical}(?:ly)?", 0.97, "flip_clip", {}),
    ("crop clip {clip} {x:int} {y:int} {width:int} {height:int}", 0.97, "crop_resize", {}),
    *[(f"set {name} clip {{clip}} {{{name}:{kind}}}", 0.95, "set_adjustments", {}) for name, kind in (("brightness", "signed"), ("contrast", "num"), ("saturation", "num"), ("exposure", "signed"), ("temperature", "signed"))],
    ("set preset clip {clip} {preset:warm|cool|cinematic|vintage|mono}", 0.95, "set_adjustments", {}),
    # sound
    ("set volume clip {clip} {volume:num}", 0.95, "set_volume", {}),
    ("{mute:mute/unmute} clip {clip}", 0.95, "set_volume", {}),
    *[(f"audio fade {way} clip {{clip}} {{fade_{way}_sec:time}}", 0.95, "set_volume", {"track_kind": "audio"}) for way in ("in", "out")],
    ("[set] track {track_kind:video|audio} volume [to] {volume:num}", 0.97, "set_volume", {}),
    *[(f"{{{name}:{name}/un{name}}} {words}", 0.97, "set_volume", {}) for name in ("mute", "solo") for words in ("track {track_kind:video|audio}", "{track_kind:video|audio} track")],
    # texts: quoted ones are surer
    *[(f"add text|title|caption {text} at {{start_sec:time}} [for {{duration_sec:time=2.0}}]", sure, "add_text_overlay", {}) for text, sure in (('"{text:quoted}"', 0.97), ("'{text:quoted}'", 0.97), ("{text:words}", 0.9))],
    # media
    *[(f"add {said} asset {{asset_id}} from {{start_sec:time}} to {{end_sec:time}} [at {{timeline_start_sec:time=0.0}}]", 0.97, op, {}) for said, op in (("clip|video", "add_clip"), ("audio", "add_audio_track"))],
    # the project
    ("[set] aspect [ratio] {ratio:ratio}", 0.97, "set_aspect_ratio", {}),
    (r"export|render {resolution:720p|1080p|4k} {fps:24|30|60}\s*fps {quality:low|medium|high|max} [quality] {format:mp4|mov|webm}", 0.98, "set_export_settings", {}),
]
#: fixed values: what to try where a prompt isn't understood, and where there is none
SUGGESTIONS = [
    "trim clip 1 from 00:05 to 00:12", "split clip 2 at 00:07", "merge clips 1,2,3", 'add text "New drop" at 00:02 for 3s', "set aspect 9:16", "crop clip 1 0 0 1080 1920",
    "set saturation clip 1 1.2", "track audio volume 0.7", "audio fade out clip 1 1.2s", "move clip 2 to 00:05", "delete clip 2", "export 1080p 30fps high mp4",
]
FIRST_SUGGESTIONS = ["Try: trim clip 1 from 00:05 to 00:12", 'Try: add text "Subscribe" at 00:02 for 3s', "Try: transition clip 1 dissolve 0.6s"]
#: fixed values: numbers that name clips
CARDINALS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
ORDINALS = ["first", "second", "third", "fourth", "fifth"]


@dataclass(frozen=True)
class Slot:
    name: str
    kind: str
    group: int
    default: float | None = None


def compiled(phrase: str) -> tuple[str, list[Slot]]:
    """The pattern of a whole prompt that says a phrase, and its slots."""
    slots: list[Slot] = []

    def slot(match: re.Match) -> str:
        name, _, kind = match[1].partition(":")
        kind, _, default = kind.partition("=")
        slots.append(Slot(name, kind or "ref", len(slots) + 1, float(default) if default else None))
        return f"({KINDS.get(kind or 'ref', kind.replace('/', '|'))})"

    def part(text: str) -> str:
        """One word, with its alternatives or its slot."""
        if "{" in text:
            return re.sub(r"\{([^}]*)\}", slot, text)
        return f"(?:{text})" if "|" in text else text

    out, begun = "", False
    for piece in re.findall(r"\[[^\]]*\]|\S*\{[^}]*\}\S*|\S+", phrase):
        if piece[0] != "[":
            out += (r"\s+" if begun else "") + part(piece)
            begun = True
        else:
            inner = r"\s+".join(map(part, piece[1:-1].split(" ")))
            out += rf"(?:\s+{inner})?" if begun else rf"(?:{inner}\s+)?"
    return rf"(?i)^{out}$", slots


#: fixed values: how wordings become plain, in this order
PLAIN = [
    (r"[.!?]+$", ""),
    (r"^(?:please|pls|can you|could you|would you|kindly)\s+", ""),
    (r"\s+(?:please|pls)$", ""),
    (r"\bclip\s*#\s*(\d+)\b", "clip $1"),
    (r"\b(\d+(?:\.\d+)?)\s*(?:sec|secs|second|seconds)\b", "$1s"),
    *[(said.format(word), f"clip {number}") for words in (CARDINALS, ORDINALS) for number, word in enumerate(words, 1) for said in (r"\b{}\s+clip\b", r"\bclip\s+{}\b")],
]


def plain_prompt(prompt: Column) -> Column:
    """A prompt with single blanks, without final marks and politeness at either end, with seconds as s and clips'
    numbers as digits. Seconds come first: "5 second clip" is about seconds, not about the second clip."""
    text = F.trim(F.regexp_replace(F.coalesce(prompt, F.lit("")), r"\s+", " "))
    for pattern, plain in PLAIN:
        text = F.regexp_replace(text, f"(?i){pattern}", plain)
    return text


def _value(text: Column, pattern: str, slot: Slot) -> Column:
    found = F.nullif(F.regexp_extract(text, pattern, slot.group), F.lit(""))
    if slot.kind == "time":
        return F.when(found.isNull(), F.lit(slot.default).cast("double")).otherwise(timecode(found, strict=False)).cast("string")
    if slot.kind in ("num", "signed", "times"):
        return found.cast("double").cast("string")
    if slot.kind == "int":
        return found.cast("int").cast("string")
    if slot.kind == "list":
        return F.array_join(F.filter(F.split(found, r"[,\s]+"), lambda x: x != ""), ",")
    if "/" in slot.kind:
        return (F.lower(found) == slot.kind.partition("/")[0]).cast("string")
    return F.lower(found) if "|" in slot.kind else found


def parsed(prompts: DataFrame, column: str = "prompt") -> DataFrame:
    """Adds op_type, params (map of strings), confidence, error and suggestions to prompts. The first phrase that a
    prompt says decides; one of its timecodes that can't be read is an error, as are empty and unknown prompts (no
    operation, confidence 0), for which there are suggestions."""
    # an array of one is exploded so that later steps read the value instead of repeating its expression
    once = lambda c: F.explode(F.array(c))
    rows = prompts.withColumn("_p", once(plain_prompt(F.col(column))))
    every = [compiled(phrase) for phrase, *_ in PHRASES]
    said, params, timed = F.lit(-1), F.lit(None).cast("map<string,string>"), F.lit(True)
    for i, (pattern, _) in reversed(list(enumerate(every))):
        said = F.when(F.col("_p").rlike(pattern), i).otherwise(said)
    rows = rows.withColumn("_g", once(said))
    for i, (pattern, slots) in enumerate(every):
        values = {s.name: _value(F.col("_p"), pattern, s) for s in slots} | {k: F.lit(v) for k, v in PHRASES[i][3].items()}
        params = F.when(F.col("_g") == i, F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))).otherwise(params)
        for s in slots:
            if s.kind == "time":
                timed = timed & ~((F.col("_g") == i) & F.col("params")[s.name].isNull())
    rows = rows.withColumn("params", once(params))
    pick = lambda k, kind: F.get(F.array(*[F.lit(p[k]) for p in PHRASES]), F.col("_g")).cast(kind)
    ok = (F.col("_g") >= 0) & timed
    error = F.when(F.col("_p") == "", "empty prompt").when(F.col("_g") < 0, "unknown command").when(~timed, "invalid timecode")
    listed = lambda items: F.array(*map(F.lit, items))
    tips = F.when(F.col("_p") == "", listed(FIRST_SUGGESTIONS)).when(F.col("_g") < 0, listed(SUGGESTIONS)).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"op_type": F.when(ok, pick(2, "string")), "confidence": F.when(ok, pick(1, "double")).otherwise(0.0), "error": error, "suggestions": tips, "params": F.when(ok, F.col("params"))}).drop("_p", "_g")
