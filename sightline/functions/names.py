"""Names, labels and other text, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which fixture types a noun hints at, the more specific needles first; the types that open; ordinals; names that are no fixture.
NOUN_TYPES = (
    ("top microwave", ("top_microwave", "microwave")),
    ("top cupboard", ("top_cupboard", "cupboard")),
    ("top drawer", ("top_drawer", "drawer")),
    ("top fridge", ("top_fridge", "fridge", "fridgefreezer")),
    ("top storage", ("top_storage", "storage")),
    ("fridge freezer", ("fridgefreezer", "fridge", "freezer")),
    ("fridge-freezer", ("fridgefreezer", "fridge", "freezer")),
    ("washing machine", ("washingmachine",)),
    ("dishwasher", ("dishwasher",)),
    ("microwave", ("microwave", "top_microwave")),
    ("freezer", ("freezer", "fridgefreezer")),
    ("fridge", ("fridge", "fridgefreezer", "top_fridge")),
    ("cupboard", ("cupboard", "top_cupboard")),
    ("cabinet", ("cupboard", "top_cupboard")),
    ("drawer", ("drawer", "top_drawer")),
    ("oven", ("oven",)),
    ("bin", ("bin",)),
    ("storage", ("storage", "top_storage")),
)
OPENABLE_TYPES = (
    "cupboard", "top_cupboard", "drawer", "top_drawer", "fridge", "top_fridge", "fridgefreezer", "freezer", "oven", "dishwasher", "microwave", "top_microwave",
    "washingmachine", "bin", "storage", "top_storage",
)
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "another", "other")
HALVES = ("first", "second", "third", "fourth", "fifth", "another", "other")
NOT_FIXTURES = ("", "mid-air")
VERB_OPEN, VERB_CLOSE = 3, 4


def squeezed(name: Column) -> Column:
    """Lower case, trimmed, each run of white space one space."""
    return F.trim(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " "))


def base_name(name: Column) -> Column:
    """A name without what only tells like objects apart: commas, trailing digits, a leading ordinal."""
    s = F.trim(F.regexp_replace(F.replace(squeezed(name), F.lit(","), F.lit(" ")), r"\s+", " "))
    s = F.trim(F.regexp_replace(s, r"\d+$", ""))
    s = F.trim(F.regexp_replace(s, rf"^({'|'.join(ORDINALS)})\s+", ""))
    return F.trim(F.regexp_replace(s, rf"^({'|'.join(HALVES)})\s+half\s+of\s+", ""))


def class_name(name: Column) -> Column:
    """As a detector's class: trailing digits go before commas do, and ordinals stay."""
    s = F.trim(F.regexp_replace(squeezed(name), r"\d+$", ""))
    return F.trim(F.regexp_replace(F.replace(s, F.lit(","), F.lit(" ")), r"\s+", " "))


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(F.trim(F.replace(F.lower(name), F.lit("_"), F.lit(" "))), r"\s+"), lambda x: x != "")


def fixture_label(raw: Column) -> Column:
    """P04_counter.004 becomes counter; mid-air stays; a blank name is null."""
    name = F.trim(raw)
    stem = F.substring_index(name, ".", 1)
    label = F.when(F.contains(stem, F.lit("_")), F.regexp_replace(stem, "^[^_]*_", "")).otherwise(stem)
    return F.when(name == "mid-air", "mid-air").when(name != "", F.lower(label))


def fixture_parts(raw: Column) -> Column:
    """(participant, fixture_type): before the first underscore, and from there to the first dot."""
    return F.struct(F.split(raw, "_", 2)[0].alias("participant"), F.substring_index(F.get(F.split(raw, "_", 2), F.lit(1)), ".", 1).alias("fixture_type"))


def valid_fixture(label: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(label)).isin(*NOT_FIXTURES), F.lit(False))


def is_counter(label: Column) -> Column:
    return F.coalesce(F.lower(F.trim(label)) == "counter", F.lit(False))


def noun_types(nouns: Column) -> Column:
    """The openable fixture types that an array of nouns hints at, in order, each once: a noun's first needle counts."""
    def of(noun: Column) -> Column:
        phrase, out = F.lower(noun), F.array().cast("array<string>")
        for needle, types in reversed(NOUN_TYPES):
            out = F.when(F.contains(phrase, F.lit(needle)), F.array(*(F.lit(t) for t in types if t in OPENABLE_TYPES))).otherwise(out)
        return out

    return F.array_distinct(F.flatten(F.transform(nouns, of)))


def event_state(verbs: Column) -> Column:
    """open if any verb class is the opening one, else closed if any is the closing one, else null."""
    return F.when(F.array_contains(verbs, VERB_OPEN), "open").when(F.array_contains(verbs, VERB_CLOSE), "closed")


def nouns_of(pairs: Column, classes: Column, verb: int) -> Column:
    """The nouns of pairs whose class has the verb; null if the arrays differ in length."""
    zipped = F.arrays_zip(pairs.alias("p"), classes.alias("c"))
    return F.when(F.size(pairs) == F.size(classes), F.transform(F.filter(zipped, lambda z: z["c"]["verb"] == verb), lambda z: z["p"]["noun"]))


def name_decision(name: Column, duplicate: Column, mode: str, vocabulary: Column | None = None, most_words: int = 2) -> Column:
    """kept, or why a name is dropped: duplicate_name, structural (too many words, or one that joins or counts), lvis_vocabulary."""
    tokens = name_tokens(name)
    joins = ("of", "with", "for", "in", "first", "second", "third", "fourth", "fifth", "another", "other")
    plain = (F.size(tokens) > 0) & (F.size(tokens) <= most_words) & ~F.exists(tokens, lambda t: t.isin(*joins) | t.rlike(r"\d"))
    out = F.when(duplicate, "duplicate_name")
    if mode in ("structural", "lvis"):
        out = out.when(~plain, "structural")
    if mode == "lvis" and vocabulary is not None:
        out = out.when(~vocabulary, "lvis_vocabulary")
    return out.otherwise("kept")


def clock(t: Column) -> Column:
    """HH:MM:SS.s of seconds; tenths are rounded to even, as a whole number."""
    tenths = F.rint(F.greatest(F.lit(0.0), t) * 10).cast("long")
    whole = F.floor(tenths / 10).cast("long")
    return F.format_string("%02d:%02d:%02d.%d", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60, tenths % 10)


def time_token(t: Column, video: int = 1) -> Column:
    return F.concat(F.lit("<TIME "), clock(t), F.lit(f" video {video}>"))


def horizon_token(h: Column) -> Column:
    """h5p0 for 5 seconds."""
    tenths = F.rint(h * 10).cast("long")
    return F.format_string("h%dp%d", F.floor(tenths / 10).cast("long"), tenths % 10)


def short_number(x: Column, places: int = 4) -> Column:
    """Rounded, without zeros at the end or a bare point; what is negative and rounds to 0 keeps its sign."""
    rounded = F.bround(x, places)
    signed = F.when((rounded == 0) & F.startswith(F.format_string("%.1f", x), F.lit("-")), F.lit(-0.0)).otherwise(rounded)
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", signed), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def seconds_of(text: Column) -> Column:
    """The seconds of HH:MM:SS.s."""
    p = F.split(text, ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def minutes_of(t: Column) -> Column:
    whole = F.floor(t).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def item_id(video: Column, obj: Column, *times: Column) -> Column:
    """The first twelve hex digits of the SHA-1 of the parts, times with six places."""
    return F.substring(F.sha1(F.concat_ws("|", video, obj, *(F.format_string("%.6f", t) for t in times))), 1, 12)


def file_name(name: Column) -> Column:
    """Letters, digits, - and _ stay, others become _, which doesn't stand at an end; an empty name is unnamed."""
    s = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    return F.when(s == "", "unnamed").otherwise(s)


def answer_text(choices: Column, index: Column, fallback: Column) -> Column:
    """The choice at an index from 0, if there is one, else the fallback."""
    return F.coalesce(F.when(index >= 0, F.get(choices, index)), fallback)


def text_of_any(value: Column) -> Column:
    """A value of any type as text: structs and arrays as JSON."""
    return F.to_json(F.struct(value.alias("v")))


def prompt_classes(prompt: Column) -> Column:
    """Classes of a prompt that separates them by dots or commas: trimmed, lower case, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(prompt, "[.,]"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def class_prompt(classes: Column) -> Column:
    return F.concat(F.concat_ws(". ", classes), F.lit("."))


def tidy_choices(choices: Column) -> Column:
    """Trimmed, without empty ones, each once, in order."""
    return F.array_distinct(F.filter(F.transform(choices, lambda x: F.trim(x)), lambda x: x != ""))


def with_areas(labels: Column, areas: Column) -> Column:
    """The labels with each `counter` replaced by the areas; each label once, in order."""
    return F.array_distinct(F.flatten(F.transform(labels, lambda x: F.when(is_counter(x), areas).otherwise(F.array(x)))))


def path_of(root: str, video: Column, suffix: str = ".mp4") -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), video, F.lit(suffix))


def hash_order(seed: int | str, *parts: Column) -> Column:
    """The text to order by for a seeded shuffle that any engine repeats."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def hash_unit(seed: int | str, *parts: Column) -> Column:
    """A seeded number in [0, 1) from the first 12 hex digits of the hash."""
    return F.conv(F.substring(hash_order(seed, *parts), 1, 12), 16, 10).cast("double") / float(16**12)


def shuffled(choices: Column, seed: int | str, key: Column) -> Column:
    """The choices in a seeded order."""
    return F.transform(F.array_sort(F.transform(choices, lambda c: F.struct(hash_order(seed, key, c).alias("h"), c.alias("c")))), lambda s: s["c"])


def answer_index(choices: Column, answer: Column) -> Column:
    return (F.array_position(choices, answer) - 1).cast("int")


def with_distractors(answer: Column, vocabulary: Sequence[str] | Column, count: int, seed: int | str, key: Column) -> Column:
    """count choices in a seeded order: the answer and count - 1 others of the vocabulary; null if it is too small."""
    words = vocabulary if isinstance(vocabulary, Column) else F.array(*(F.lit(x) for x in vocabulary))
    others = F.slice(shuffled(F.array_except(F.array_distinct(words), F.array(answer)), seed, key), 1, count - 1)
    return F.when(F.size(others) == count - 1, shuffled(F.concat(F.array(answer), others), f"{seed}:order", key))


def domain_difference(first: Sequence[str], drop: Sequence[str], add: Sequence[str]) -> Column:
    """A status domain without some and with other statuses."""
    lit = lambda xs: F.array(*(F.lit(x) for x in xs))
    return F.array_union(F.array_except(lit(first), lit(drop)), lit(add))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def tick_step(length: Column) -> Column:
    """Seconds between the ticks of an axis of so many seconds."""
    return F.when(length <= 60, 10).when(length <= 300, 30).when(length <= 900, 60).otherwise(300)
