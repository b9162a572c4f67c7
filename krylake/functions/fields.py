"""Fields, waves, shapes and sizes as Column expressions: built-in functions only, so they stay in generated code."""

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CITY = 100.0

#: Base x, base y, radius, amplitude, phases of x and y, pulse frequency.
HOTSPOTS = (
    (27.0, 42.0, 9.0, 0.90, 0.06, 0.04, 0.15),
    (36.0, 37.0, 8.0, 0.80, -0.05, 0.07, 0.20),
    (46.0, 32.0, 11.0, 0.70, 0.04, -0.06, 0.12),
    (49.0, 41.0, 8.0, 0.65, -0.04, -0.03, 0.25),
)

#: Unit and usual range of each sensor field.
FIELD_RANGES = {"temperature": ("°C", 10.0, 20.0), "pressure": ("hPa", -15.0, 15.0), "humidity": ("%", 0.0, 80.0)}


def uniform(*keys: Column) -> Column:
    """In (0, 1), from a hash of the keys: the same whatever the partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53)


def normal(*keys: Column) -> Column:
    """Standard normal by Box and Muller from two hashes of the keys."""
    return F.sqrt(-2.0 * F.log(uniform(*keys, F.lit(1)))) * F.cos(2.0 * math.pi * uniform(*keys, F.lit(2)))


def lattice(key: Column) -> Column:
    """In (0, 1), from a whole number below 2^31 by one multiplication: not as well mixed as `uniform`, but the same in any engine."""
    return (F.pmod(key.cast("long") * 2654435761, F.lit(1 << 32)).cast("double") + 0.5) / float(1 << 32)


def lattice_normal(key: Column) -> Column:
    """Standard normal by Box and Muller from two lattice numbers."""
    return F.sqrt(-2.0 * F.log(lattice(key * 2 + 1))) * F.cos(2.0 * math.pi * lattice(key * 2 + 2))


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def weather_front(x: Column, y: Column, t: Column) -> Column:
    return 15.0 + 5.0 * F.sin((x + y) / 20.0 - 0.5 * t)


temperature = weather_front


def pressure(x: Column, y: Column, t: Column) -> Column:
    """A low that circles the middle with radius 10, and a standing wave."""
    r2 = F.pow(x - (50.0 + 10.0 * F.cos(t * 0.3)), 2) + F.pow(y - (50.0 + 10.0 * F.sin(t * 0.3)), 2)
    return -12.0 * F.exp(-r2 / 800.0) + 3.0 * F.sin(x / 15.0)


def humidity(x: Column, y: Column, t: Column) -> Column:
    return 40.0 * F.exp(-x / 30.0) + 10.0 * F.sin(2.0 * math.pi * t / 24.0 - y / 25.0)


FIELDS = {"temperature": (temperature, 0.05), "pressure": (pressure, 0.1), "humidity": (humidity, 0.5)}


def sensor_field(name: str, x: Column, y: Column, t: Column, key: Column | None = None) -> Column:
    """A field by name; with a key, measured with that field's noise."""
    if name not in FIELDS:
        raise ValueError(f"unknown field {name!r}; there are {', '.join(sorted(FIELDS))}")
    base, std = FIELDS[name]
    return base(x, y, t) if key is None else base(x, y, t) + std * normal(key, t.cast("double"), F.lit(name))


def bump(x: Column, y: Column, cx: Column, cy: Column, sigma: Column, amp: Column) -> Column:
    return amp * F.exp(-(F.pow(x - cx, 2) + F.pow(y - cy, 2)) / (2.0 * F.pow(sigma, 2)))


def hotspots(x: Column, y: Column, t: Column) -> Column:
    """Sum of the pulsing hotspots, not clipped."""
    total = F.lit(0.0)
    for cx, cy, sigma, amp, px, py, w in HOTSPOTS:
        strength = amp * (0.85 + 0.15 * F.sin(2.0 * w * t))
        total = total + bump(x, y, cx + 5.0 * F.sin(w * t + px), cy + 5.0 * F.cos(w * t * 0.7 + py), F.lit(sigma), strength)
    return total


def incident_strength(t: Column, t_start: Column, duration: Column) -> Column:
    """1, fading over the last fifth of the duration to 0; without end where duration is negative. 0 before the start and for duration 0."""
    frac = (t - t_start) / F.when(duration == 0, None).otherwise(duration)
    return F.when(duration < 0, 1.0).when((duration == 0) | (t < t_start) | (frac >= 1.0), 0.0).when(frac > 0.8, 1.0 - (frac - 0.8) / 0.2).otherwise(1.0)


def incident_lasts(t: Column, t_start: Column, duration: Column) -> Column:
    return (duration < 0) | (t - t_start < duration)


def to_plane(lat: Column, lng: Column, south: float, north: float, west: float, east: float, size: float = CITY) -> tuple[Column, Column]:
    """Linear coordinates in a square of side `size` over a box of degrees."""
    return (lng - west) / (east - west) * size, (lat - south) / (north - south) * size


def linspace(i: Column, n: int, lo: float, hi: float) -> Column:
    """The i-th of n points from lo to hi, both included."""
    return lo + i * ((hi - lo) / (n - 1)) if n > 1 else F.lit(lo)


def wave(x: Column, y: Column, k: Column, alpha: Column) -> tuple[Column, Column]:
    """Real and imaginary part of a plane wave with wave number k from direction alpha."""
    phase = k * (x * F.cos(alpha) + y * F.sin(alpha))
    return F.cos(phase), F.sin(phase)


def display(re: Column, im: Column) -> dict[str, Column]:
    """What a client shows of a complex field."""
    return {"re": re, "im": im, "abs": F.sqrt(re * re + im * im), "power": re * re + im * im, "phase": F.atan2(im, re)}


def power_label(p: Column) -> Column:
    """Thresholds and names of the bins."""
    return F.when(p < 0.05, "CLOAK").when(p < 0.15, "LOW").when(p < 0.5, "MED").when(p < 1.0, "HIGH").otherwise("LOUD")


def perimeter(kind: Column, a: Column, b: Column) -> Column:
    """Of an ellipse (half axes; Ramanujan), circle (radius a), submarine (length a, radius b), rect (width, height); 8 for others."""
    ellipse = math.pi * (3 * (a + b) - F.sqrt((3 * a + b) * (a + 3 * b)))
    return F.when(kind == "ellipse", ellipse).when(kind == "circle", 2 * math.pi * a).when(kind == "submarine", 2 * a + 2 * math.pi * b).when(kind == "rect", 2 * (a + b)).otherwise(8.0)


def recommended_panels(k: float, longest: Column) -> Column:
    """Ten panels a wavelength along the longest perimeter, 60 at least."""
    return F.greatest(F.lit(60), F.ceil(10 * k * longest / (2 * math.pi))).cast("long")


def matrix_bytes(n: Column) -> tuple[Column, Column, Column]:
    """Bytes of an n x n matrix in double precision, in single, and in both."""
    n2 = n.cast("double") * n.cast("double")
    return n2 * 8.0, n2 * 4.0, n2 * 12.0


def backend(n: Column, fast_bytes: float, ram_bytes: float) -> Column:
    """0: in fast memory; 1: blocks in RAM, beyond 60 % of the fast memory; 2: blocks on disk, beyond 80 % of the RAM too."""
    need = matrix_bytes(n)[1]
    return F.when(need <= 0.6 * fast_bytes, 0).when(need <= 0.8 * ram_bytes, 1).otherwise(2).cast("long")


def cubic_seconds(n: Column, seconds: float = 1.6, at: int = 6000) -> Column:
    return seconds * F.pow(n.cast("double") / float(at), 3)


def time_label(s: Column) -> Column:
    return F.when(s < 2, F.format_string("%.2fs", s)).when(s < 120, F.format_string("%.0fs", s)).otherwise(F.format_string("%.1fmin", s / 60))


def outer_iterations(n: Column, least: int = 6, slope: float = 1.5) -> Column:
    """Outer refinements for a system of n unknowns."""
    return F.greatest(F.lit(least), least + ((n.cast("double") / 8192.0 - 1.0) * slope).cast("long")).cast("long")


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def sanitised(v: Column, instead: float = 0.0) -> Column:
    """The value, or `instead` where it isn't finite."""
    return F.when(finite(v), v).otherwise(F.lit(instead))


def from_canvas(px: Column, py: Column, width: float, height: float, size: float) -> tuple[Column, Column]:
    """Pixels from the upper left corner to a plane of side `size` about the middle, y upwards."""
    return (px - width / 2) / width * size, (height / 2 - py) / height * size


def measured(truth: Column, key: Column, std: float = 0.08, source: Callable[[Column], Column] = normal) -> Column:
    """A reading: the truth with normal noise, a function of the key alone."""
    return truth + std * source(key)


def clamped_settings(k: Column, panels: Column) -> tuple[Column, Column]:
    """Wave number within 1 and 30, number of panels within 60 and 500."""
    return clip(k, 1.0, 30.0), F.least(F.greatest(panels, F.lit(60)), F.lit(500))
