"""Music theory and text as column expressions (and the same small tables as Python values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chord qualities as (name, symbol, has a seventh, semitones above the root).
QUALITIES = [
    ("MAJOR", "", False, (0, 4, 7)),
    ("MINOR", "m", False, (0, 3, 7)),
    ("DIMINISHED", "dim", False, (0, 3, 6)),
    ("AUGMENTED", "aug", False, (0, 4, 8)),
    ("SUSPENDED_SECOND", "sus2", False, (0, 2, 7)),
    ("SUSPENDED_FOURTH", "sus4", False, (0, 5, 7)),
    ("DOMINANT_SEVENTH", "7", True, (0, 4, 7, 10)),
    ("MAJOR_SEVENTH", "maj7", True, (0, 4, 7, 11)),
    ("MINOR_SEVENTH", "m7", True, (0, 3, 7, 10)),
    ("MINOR_MAJOR_SEVENTH", "mMaj7", True, (0, 3, 7, 11)),
    ("HALF_DIMINISHED_SEVENTH", "m7b5", True, (0, 3, 6, 10)),
    ("DIMINISHED_SEVENTH", "dim7", True, (0, 3, 6, 9)),
    ("SIXTH", "6", False, (0, 4, 7, 9)),
    ("MINOR_SIXTH", "m6", False, (0, 3, 7, 9)),
    ("NONE", "N.C.", False, ()),
]
# Qualities that the symbolic decoder knows, with the fit each must make up for.
PRIORS = [
    ("MAJOR", 0.00),
    ("MINOR", 0.00),
    ("DOMINANT_SEVENTH", 0.10),
    ("MAJOR_SEVENTH", 0.10),
    ("MINOR_SEVENTH", 0.10),
    ("SUSPENDED_FOURTH", 0.08),
    ("SUSPENDED_SECOND", 0.10),
    ("DIMINISHED", 0.08),
    ("AUGMENTED", 0.14),
    ("HALF_DIMINISHED_SEVENTH", 0.14),
    ("DIMINISHED_SEVENTH", 0.14),
]
SHARPS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FLATS = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
MAJOR_SCALE, NATURAL_MINOR = (0, 2, 4, 5, 7, 9, 11), (0, 2, 3, 5, 7, 8, 10)
LETTERS_BY_FIFTHS = "FCGDAEB"
#: Divisions of a beat that a grid may have.
RESOLUTIONS = (1, 2, 3, 4, 6, 8)

INTERVALS = {name: steps for name, _, _, steps in QUALITIES}
SYMBOLS = {name: symbol for name, symbol, _, _ in QUALITIES}


def templates() -> list[tuple[int, str, int, tuple[int, ...], float]]:
    """(state, quality, root, pitch classes, prior) of the symbolic decoder's chords."""
    return [(q * 12 + root, name, root, tuple((root + s) % 12 for s in INTERVALS[name]), prior) for q, (name, prior) in enumerate(PRIORS) for root in range(12)]


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index)


def quality_symbol(quality: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, s, _, _ in QUALITIES for x in (n, s)]), quality), F.lit(""))


def pitch_class(midi: Column) -> Column:
    """M7."""
    return F.pmod(midi, F.lit(12))


def sharp_name(pc: Column) -> Column:
    """M8: spelling with sharps."""
    return pick(SHARPS, pc)


def flat_name(pc: Column) -> Column:
    """M8: spelling with flats."""
    return pick(FLATS, pc)


def pitch_name(midi: Column, flats: bool = False) -> Column:
    """name and octave, C4 for 60."""
    name = flat_name(pitch_class(midi)) if flats else sharp_name(pitch_class(midi))
    return F.concat(name, (F.floor(midi / 12) - 1).cast("string"))


def parse_pitch(text: Column) -> Column:
    """MIDI number of a written pitch such as Bb-1 or F##4; null if it isn't one."""
    pattern = "^([A-G])(bb|b|##|#)?(-?[0-9])$"
    letter, mark, octave = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    base = F.element_at(F.create_map(*[F.lit(x) for p in zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11)) for x in p]), letter)
    alter = F.when(mark == "bb", -2).when(mark == "b", -1).when(mark == "#", 1).when(mark == "##", 2).otherwise(0)
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), (F.when(octave == "", None).otherwise(octave).cast("int") + 1) * 12 + base + alter)


def chord_symbol(root: Column, quality: Column, bass: Column) -> Column:
    """root, quality and, where the bass is another pitch class, /bass (root and bass as pitch classes)."""
    slash = F.when(bass.isNotNull() & (bass != root), F.concat(F.lit("/"), sharp_name(bass))).otherwise(F.lit(""))
    return F.when(quality == "NONE", F.lit("N.C.")).otherwise(F.concat(sharp_name(root), quality_symbol(quality), slash))


def chord_classes(root: Column, quality: Column) -> Column:
    """Pitch classes of a chord."""
    steps = F.element_at(F.create_map(*[x for n, _, _, s in QUALITIES for x in (F.lit(n), F.array(*map(F.lit, s)).cast("array<int>"))]), quality)
    return F.transform(steps, lambda s: F.pmod(root + s, F.lit(12)))


def fifths_of(pc: Column, centre: Column) -> Column:
    """Place on the line of fifths of a pitch class, nearest to a centre (the flatter on a tie), at most two accidentals."""
    spots = F.filter(F.sequence(F.lit(-15), F.lit(19)), lambda f: F.pmod(f * 7, F.lit(12)) == pc)
    ranked = F.transform(spots, lambda f: F.struct(F.abs(f - centre).alias("far"), f.alias("fifths")))
    return F.array_min(ranked)["fifths"]


def name_at_fifths(fifths: Column) -> Column:
    """M9: note name at a place on the line of fifths (C is 0)."""
    letter = F.substring(F.lit(LETTERS_BY_FIFTHS), F.pmod(fifths + 1, F.lit(7)).cast("int") + 1, F.lit(1))
    marks = F.floor((fifths + 1) / 7).cast("int")
    return F.concat(letter, F.when(marks > 0, F.repeat(F.lit("#"), F.greatest(marks, F.lit(0)))).otherwise(F.repeat(F.lit("b"), F.greatest(-marks, F.lit(0)))))


def signature_of(tonic_pc: Column, minor: Column) -> Column:
    """M9: accidentals of a key signature, -7..7, the fewest (flats on a tie)."""
    shifted = F.pmod(tonic_pc + F.when(minor, 3).otherwise(0), F.lit(12))
    sharp = F.pmod(shifted * 7, F.lit(12))
    return F.when(sharp < 6, sharp).otherwise(sharp - 12)


def hz_to_mel(hz: Column) -> Column:
    """M1."""
    return 2595.0 * F.log10(1 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1)


def hz_to_midi(hz: Column, tuning: float = 0.0) -> Column:
    """M2."""
    return 69 + 12 * F.log2(hz / 440.0) - tuning


def midi_to_hz(midi: Column, tuning: float = 0.0) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (midi + tuning - 69) / 12)


def decibels(x: Column, least: float = 1e-10) -> Column:
    """M3."""
    return 20.0 * F.log10(F.greatest(x, F.lit(least)))


def tempo_prior(bpm: Column, centre: float = 120.0, octaves: float = 1.4) -> Column:
    """M5: log-Gaussian weight of a tempo."""
    return F.exp(-0.5 * F.pow(F.log2(bpm / centre) / octaves, F.lit(2)))


def raised_cosine(x: Column) -> Column:
    """M6: 0.5 (1 + cos(pi x)) inside [-1, 1], else 0."""
    return F.when(F.abs(x) <= 1, 0.5 * (1 + F.cos(F.pi() * x))).otherwise(0.0)


def syllables(word: Column) -> Column:
    """groups of vowels, a silent final e dropped, at least one."""
    plain = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.size(F.regexp_extract_all(plain, F.lit("[aeiouy]+"), 0))
    silent = F.when((groups > 1) & plain.rlike("[^aeiouy]e$"), 1).otherwise(0)
    return F.greatest(F.lit(1), groups - silent)


def stage_name(text: Column) -> Column:
    """name safe for a file: other characters as _, and never empty, . or .."""
    clean = F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")
    return F.when(clean.isin("", ".", ".."), F.lit("_")).otherwise(clean)


def take_name(text: Column) -> Column:
    """a recording's name: path characters and controls out, no .wav, no dots or blanks at the ends; null if nothing is left."""
    clean = F.regexp_replace(text, r"[/\\:*?\"<>|\x00-\x1f]", "_")
    clean = F.regexp_replace(F.rtrim(clean), r"(?i)\.wav$", "")
    clean = F.regexp_replace(F.substring(clean, 1, 64), r"[. ]+$|^\.+", "")
    return F.when(clean == "", None).otherwise(clean)


def quoted(text: Column) -> Column:
    """F8: with backslashes and quotes escaped."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def plain_text(text: Column) -> Column:
    """controls as blanks, trimmed, at most 96 code points."""
    return F.trim(F.substring(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "), 1, 96))


def part_role(name: Column, channel: Column) -> Column:
    """DRUMS on channel 9, BASS by name unless the name is of drums, else OTHER."""
    drums = F.lower(name).rlike(r"\b(bass drum|kick|drums?)\b")
    return F.when(channel == 9, F.lit("DRUMS")).when(F.lower(name).rlike(r"\bbass(line|es)?\b") & ~drums, F.lit("BASS")).otherwise(F.lit("OTHER"))


def duration_text(seconds: Column) -> Column:
    """M:ss."""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("bigint"), whole % 60)


def bar_length(num: Column, den: Column) -> Column:
    """Quarters in a bar."""
    return num * 4.0 / den


def is_compound(num: Column, den: Column) -> Column:
    """A numerator over 3 that 3 divides, over eighths or shorter."""
    return (num > 3) & (num % 3 == 0) & (den >= 8)


def beat_unit(num: Column, den: Column) -> Column:
    """Quarters in a counted beat."""
    return F.when(is_compound(num, den), 12.0 / den).otherwise(4.0 / den)


def meter_parts(text: Column) -> Column:
    """(num, den) of N/D; null if either isn't a number."""
    part = F.split(text, "/")
    ok = text.rlike(r"^[0-9]+/[0-9]+$")
    return F.when(ok, F.struct(F.get(part, F.lit(0)).cast("int").alias("num"), F.get(part, F.lit(1)).cast("int").alias("den")))


def letters(index: Column) -> Column:
    """A..Z, AA..ZZ, AAA.. for 0.. (bijective base 26)."""
    first = [(26**k - 26) // 25 for k in range(1, 15)]  # the lowest index of k letters; a bigint has 14 at most
    length, base = F.lit(1), F.lit(0)
    for k, low in enumerate(first[1:], 2):
        length, base = F.when(index >= low, k).otherwise(length), F.when(index >= low, F.lit(low)).otherwise(base)
    digits = F.conv((index - base).cast("string"), 10, 26)
    return F.translate(F.lpad(digits, length, "0"), "0123456789ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def duration_token(quarters: Column) -> Column:
    """LilyPond length of a note: plain, dotted, or 1*n/d, in 768ths of a quarter."""
    ticks = F.floor(quarters * 768 + 0.5).cast("bigint")
    token = F.lit(None).cast("string")
    for k in range(7):
        plain = 768 * 4 >> k
        token = F.when(ticks == plain, F.lit(str(1 << k))).when(ticks * 2 == plain * 3, F.lit(f"{1 << k}.")).otherwise(token)
    divisor = F.aggregate(F.sequence(F.lit(1), F.lit(3072)), F.lit(1).cast("bigint"), lambda a, d: F.when((ticks % d == 0) & (3072 % d == 0), d.cast("bigint")).otherwise(a))
    return F.coalesce(token, F.concat(F.lit("1*"), F.floor(ticks / divisor).cast("string"), F.lit("/"), F.floor(3072 / divisor).cast("string")))


NOTE_TYPES = {4.0: "whole", 2.0: "half", 1.0: "quarter", 0.5: "eighth", 0.25: "16th", 0.125: "32nd", 0.0625: "64th"}


def note_type(quarters: Column) -> Column:
    """MusicXML type of an undotted note value."""
    out = F.lit(None).cast("string")
    for value, name in NOTE_TYPES.items():
        out = F.when(quarters == value, F.lit(name)).otherwise(out)
    return out


def grid_depth(divisions: Column) -> Column:
    """How deep a grid divides the beat: halvings, a third counting as one."""
    return F.when(divisions == 1, 0).when(divisions.isin(2, 3), 1).when(divisions.isin(4, 6), 2).otherwise(3)


def is_tuplet(divisions: Column) -> Column:
    return divisions % 3 == 0


def clef(role: Column) -> Column:
    """M20."""
    return F.when(role == "BASS", "bass_8").when(role == "PIANO_LEFT", "bass").otherwise("treble")


def next_power_of_two(x: Column) -> Column:
    """M18, for whole numbers up to 2**52."""
    p = F.pow(F.lit(2.0), F.ceil(F.log2(x.cast("double")))).cast("bigint")
    return F.when(p >= 2 * x, F.floor(p / 2)).when(p < x, p * 2).otherwise(p).cast("bigint")
