"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")
#: Reference frequency of semitones, and the constants of the ERB-rate scale.
SEMITONE_REFERENCE = 16.35160
ERB = (11.17, 0.312, 14.675, 43.0)
#: First formants by speaker group, and the age under which a speaker is a child.
NOMINAL_F1 = {"child": 1000, "male": 500, "female": 560, "other": 530}
CHILD_AGE = 12
#: Coefficients of the bandwidth polynomial below and from 500 Hz, by rising power of frequency.
BANDWIDTH_LOW = (165.327516, -6.73636734e-1, 1.80874446e-3, -4.52201682e-6, 7.49514000e-9, -4.70219241e-12)
BANDWIDTH_HIGH = (15.8146139, 8.10159009e-2, -9.79728215e-5, 5.28725064e-8, -1.07099364e-11, 7.91528509e-16)


def semitones(hz: Column, reference: float = SEMITONE_REFERENCE) -> Column:
    return F.lit(12) * F.log2(hz / F.lit(reference))


def erb_rate(f: Column) -> Column:
    a, b, c, d = ERB
    return F.lit(a) * F.log((f + b) / (f + c)) + d


def octave(value: Column) -> Column:
    return F.when(value > 0, F.log2(value)).otherwise(F.lit(0.0))


def linear(value: Column) -> Column:
    return F.pow(F.lit(2.0), value)


def round_half_up(value: Column) -> Column:
    """Half up by truncation, as tone targets are rounded."""
    return (value + 0.5).cast("int")


def format_bytes(n: Column) -> Column:
    """`1.50 KB`; zero and null are `0 B`."""
    power = F.least(F.floor(F.log2(n.cast("double")) / 10), F.lit(len(UNITS) - 1))
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (power + 1).cast("int"))
    return F.when(n.isNull() | (n <= 0), F.lit("0 B")).otherwise(F.format_string("%.2f %s", F.bround(n / F.pow(F.lit(1024.0), power), 2), unit))


def parse_size(text: Column) -> Column:
    """Bytes of `1.5 GB` or `500kb`; null where it can't be read."""
    value = F.regexp_extract(text, r"(?i)^\s*([0-9]*\.?[0-9]+)\s*([KMGT]?B)\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"(?i)^\s*([0-9]*\.?[0-9]+)\s*([KMGT]?B)\s*$", 2))
    power = F.array_position(F.array(*map(F.lit, UNITS)), unit) - 1
    return F.when(value != "", value.try_cast("double") * F.pow(F.lit(1024.0), power))


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def to_samples(ms: Column, rate: Column) -> Column:
    """Milliseconds to a sample, half to even."""
    return F.bround(ms / 1000 * rate).cast("bigint")


def to_ms(sample: Column, rate: Column) -> Column:
    return sample / rate * 1000


def parameter_hash(parameters: dict[str, Column]) -> Column:
    """A digest that doesn't depend on the order of the names."""
    return F.md5(F.to_json(F.struct(*[parameters[k].alias(k) for k in sorted(parameters)])))


def cache_key(function: str, parameters: dict[str, Column]) -> Column:
    values = F.xxhash64(F.to_json(F.struct(*[parameters[k].alias(k) for k in sorted(parameters)]))) if parameters else F.lit(0)
    return F.concat_ws("_", "session", "bundle", "start", "end", F.lit(function), values)


def merge_maps(base: Column, over: Column) -> Column:
    """over's entries win; its null values take an entry away."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return F.map_concat(kept, F.map_filter(over, lambda _, v: v.isNotNull()))


def without_glitches(f0: Column, ratio: float = 1.05) -> Column:
    """Zero where a value is more than ratio times both neighbours."""

    def one(x: Column, i: Column) -> Column:
        left, right = F.get(f0, i - 1), F.get(f0, i + 1)
        return F.when((x > left * ratio) & (x > right * ratio), F.lit(0.0)).otherwise(x)

    return F.transform(f0, one)


def clip(value: Column, least: float, most: float) -> Column:
    return F.greatest(F.least(value, F.lit(most)), F.lit(least))


def frame_index(at: Column, n: Column) -> Column:
    """The 1-based frame at a relative position, half to even, within 1 and n."""
    return F.greatest(F.lit(1), F.least(n, F.bround(at * n).cast("int")))


def bandwidth(formant: Column, f0: Column) -> Column:
    """Bandwidth of a formant by a polynomial of its frequency, scaled by f0."""
    scale = 1 + 0.25 * (f0 - 132) / 88

    def polynomial(c: tuple[float, ...]) -> Column:
        total = F.lit(0.0)
        for x in c[::-1]:
            total = total * formant + x
        return total

    return scale * F.when(formant < 500, polynomial(BANDWIDTH_LOW)).otherwise(polynomial(BANDWIDTH_HIGH))


def formant_correction(f: Column, formant: Column, width: Column, rate: Column) -> Column:
    """Gain in dB that a formant adds to a harmonic at f."""
    radius = F.exp(-F.pi() * width / rate)
    at, around = 2 * F.pi() * formant / rate, 2 * F.pi() * f / rate

    def part(angle: Column) -> Column:
        return radius**2 + 1 - 2 * radius * F.cos(angle)

    top = (radius**2 + 1 - 2 * radius * F.cos(at)) ** 2
    return 10 * F.log10(top) - 10 * F.log10(part(around + at) * part(around - at))


def pitch_range(q25: Column, span: Column) -> tuple[Column, Column]:
    """Lowest and highest pitch to look for: three quarters of the first quartile, and span octaves above, in steps of 10."""
    low = F.floor(q25 * 0.75 / 10) * 10
    return low, F.ceil(low * F.pow(F.lit(2.0), span) / 10) * 10


def nominal_f1(gender: Column, age: Column) -> Column:
    g = F.lower(gender)
    named = F.when(g.isin("male", "m"), NOMINAL_F1["male"]).when(g.isin("female", "f"), NOMINAL_F1["female"]).otherwise(NOMINAL_F1["other"])
    return F.when(age < CHILD_AGE, NOMINAL_F1["child"]).otherwise(named)
