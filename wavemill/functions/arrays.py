"""Array and scalar functions as Spark expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signed 16-bit samples saturate.
LOW, HIGH = -32768, 32767


def saturate(x: Column) -> Column:
    """Round half away from zero to 16 bits; what is not a number is 0."""
    away = F.signum(x) * F.floor(F.abs(x) + 0.5)
    return F.when(F.isnan(x), 0).otherwise(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), away))).cast("long")


def rint16(x: Column) -> Column:
    """Round half to even to 16 bits."""
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.rint(x))).cast("long")


def floor_half(x: Column) -> Column:
    return F.floor(x + 0.5)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def roll(a: Column, k: Column | int) -> Column:
    """Shifted by k places towards the end, zeros where nothing was."""
    return F.transform(a, lambda x, i: F.coalesce(F.when(i - k >= 0, F.get(a, i - k)), F.lit(0).cast("long")))


def rotate(a: Column, k: int) -> Column:
    """Shifted by k places towards the end, around."""
    return F.transform(a, lambda x, i: F.get(a, F.pmod(i - k, F.size(a)).cast("int")))


def hann(a: Column) -> Column:
    n = F.size(a)
    return F.transform(a, lambda x, i: x * (0.5 - 0.5 * F.cos(2 * 3.141592653589793 * i / (n - 1))))


def spatial(xs: Column, order: int) -> Column:
    """Differences across channels: 0 none, 1 with the next (the last with the one before), 2 with the mean of both neighbours, 3 all pairs."""
    n = F.size(xs)
    at = lambda i: F.get(xs, i).cast("double")
    if order == 0:
        return F.transform(xs, lambda x: x.cast("double"))
    if order == 1:
        return F.transform(xs, lambda x, i: F.when(n == 1, x).when(i < n - 1, x - at(i + 1)).otherwise(x - at(i - 1)).cast("double"))
    if order == 2:
        first, last = lambda x: x - at(F.lit(1)), lambda x: x - at(n - 2)
        return F.transform(xs, lambda x, i: F.when(n == 1, x).when(i == 0, first(x)).when(i == n - 1, last(x)).otherwise(x - (at(i - 1) + at(i + 1)) / 2).cast("double"))
    total = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return F.transform(xs, lambda x: n * x - total)


def referenced(xs: Column, partners: dict[int, list[int]]) -> Column:
    """Each channel less the mean of its partners; a channel without any stays."""
    out = []
    for i, others in sorted(partners.items()):
        mean = sum((F.get(xs, j) for j in others[1:]), F.get(xs, others[0])) / len(others) if others else F.lit(0.0)
        out.append((F.get(xs, i) - mean).cast("double"))
    return F.array(*out)


def shifted(a: Column, by: float) -> Column:
    """Moved towards the end by `by` places (0 or more), linear between neighbours, zero from outside."""
    whole, part = int(by), by - int(by)
    at = lambda i: F.when(i >= 0, F.get(a, i)).otherwise(0)
    return F.transform(a, lambda x, i: (1 - part) * at(i - whole) + part * at(i - whole - 1))


def _terms(first: Column, last: Column, log_term) -> Column:
    """The sum of exp(log_term(i)) for i from first to last; 0 if there are none."""
    summed = F.aggregate(F.transform(F.sequence(first.cast("int"), last.cast("int")), log_term), F.lit(0.0), lambda s, x: s + F.exp(x))
    return F.when(first <= last, summed).otherwise(0.0)


def log_factorial(n: Column) -> Column:
    """ln n! to a relative 1e-13: the logs added up below 16, and beyond that Stirling's series."""
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(16)])
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(series)


def chi_square_tail(x: Column, df: int) -> Column:
    """The probability of more than x, for an even number of degrees of freedom: a Poisson sum of half as many terms."""
    if df % 2:
        raise ValueError("an even number of degrees of freedom")
    h = x / 2
    return F.when(h > 0, _terms(F.lit(0), F.lit(df // 2 - 1), lambda i: i * F.log(h) - h - log_factorial(i))).otherwise(1.0)


def poisson_tail(k: Column, rate: float) -> Column:
    """The probability of k or more."""
    return 1 - _terms(F.lit(0), k - 1, lambda i: i * math.log(rate) - rate - log_factorial(i))


def even_split_tail(k: Column, n: Column) -> Column:
    """The probability of k or more of n on one side where each side is as likely."""
    return _terms(k, n, lambda i: log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * math.log(2))


def wilson_hilferty(df: int, z: float) -> float:
    """The chi-square quantile at the normal quantile z."""
    return df * (1 - 2 / (9 * df) + z * (2 / (9 * df)) ** 0.5) ** 3


class ExpressionError(ValueError):
    """A channel expression that can't be read."""


#: An operand: a channel, a number, or parentheses (with others inside) and what calls them.
OPERAND = r"(?:[a-z]*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|[cd\w.]+)"


def _divisors(text: str) -> str:
    """Divisors of 0 as null."""
    return re.sub(rf"/({OPERAND})", r"/nullif(\1,0)", text)


def _powers(text: str) -> str:
    """a^b as pow(a, b), the rightmost first, so that powers bind to the right."""
    while "^" in text:
        at = text.rindex("^")
        left = re.search(OPERAND + "$", text[:at])
        right = re.match(OPERAND, text[at + 1 :])
        if not left or not right:
            raise ExpressionError(text)
        text = text[: left.start()] + f"pow({left[0]},{right[0]})" + text[at + 1 + right.end() :]
    return text


def channel_expression(source: str, xs: str = "xs") -> Column:
    """A channel expression such as c1-(c0+c2)/2 as a column over the array column named xs.

    Numbers, channels, + - * / ^ and parentheses; Spark's SQL parser reads the arithmetic, powers become pow() first. A
    channel that is not there is 0; a result that is not finite is 0, and it is held within a billion either way.
    """
    text = source.replace(" ", "")
    if not re.fullmatch(r"(?:c\d+|\d+(?:\.\d+)?|[-+*/^()])+", text):
        raise ExpressionError(source)
    text = re.sub(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])", lambda m: f"{float(m[1])}D", _divisors(_powers(text)))
    text = re.sub(r"\bc(\d+)", rf"coalesce(CAST(get({xs}, \1) AS DOUBLE), 0D)", text)
    value = F.try_divide(F.expr(text), F.lit(1.0))
    return F.when(F.isnan(value) | value.isNull() | (F.abs(value) == float("inf")), 0.0).otherwise(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), value)))


def along_depth(a: Column, by: Column, channels: int, sample: Callable, place: Callable, channel: Callable | None = None) -> Column:
    """A flat waveform moved `by` sites (whole or not) along evenly spaced channels: linear between sites, zero from outside.

    sample(p) and channel(p) tell the sample and channel at place p (the channel is p divided by the samples, if not given), place(p, ch) the place
    of channel ch at p's sample.
    """
    channel = channel or (lambda p: F.floor(p / F.floor(F.size(a) / channels)))

    def at(p: Column) -> Column:
        target = channel(p) - by
        low = F.floor(target)
        part = target - low
        get = lambda ch: F.get(a, place(p, ch).cast("int"))
        moved = (1 - part) * get(low) + part * get(F.least(low + 1, F.lit(channels - 1)))
        return F.when((target >= 0) & (target <= channels - 1), moved).otherwise(0.0)

    return F.transform(a, lambda x, i: at(i).cast("double"))


def fourier_kernel(size: int, by: float) -> list[float]:
    """Weights of a periodic shift by `by` places: those of output n are the `size` ones from size - n on."""
    waves = range(1, size // 2)
    last = lambda j: math.cos(math.pi * by) * (-1) ** j if size % 2 == 0 else 2 * math.cos(2 * math.pi * (size // 2) * (j - by) / size)
    h = [(1 + 2 * sum(math.cos(2 * math.pi * k * (j - by) / size) for k in waves) + last(j)) / size for j in range(size)]
    return [h[-j % size] for j in range(2 * size)]


def fourier_shifted(a: Column, size: int, by: float) -> Column:
    """An array of `size` numbers moved by `by` places as a periodic signal, without loss but for the highest frequency of an even size."""
    kernel = F.array(*[F.lit(w) for w in fourier_kernel(size, by)])
    return F.transform(a, lambda x, n: dot(a, F.slice(kernel, F.lit(size + 1) - n, size)))


def share(part: Column, whole: Column, places: int) -> Column:
    """part / whole (whole numbers, 0 <= part, 0 < whole) rounded half up to so many places. In whole numbers throughout, which takes a small part of the time of rounding a double."""
    return F.floor((2 * 10**places * part + whole) / (2 * whole)) / float(10**places)
