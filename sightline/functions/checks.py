"""Column builders for rules on single rows: detector heads, quality of crops, engineering notes, purposes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_head(head: Column, n_classes: int, ratio: Column, pad_x: Column, pad_y: Column) -> dict[str, Column]:
    """Class, score and box in image pixels of a raw head row: centre, size, (objectness,) class scores.

    Whether there is an objectness is told from the row's length against the declared number of classes. Ties: first class.
    """
    with_obj = F.size(head) == n_classes + 5
    scores = F.when(with_obj, F.transform(F.slice(head, 6, n_classes), lambda s: s * head[4])).when(F.size(head) == n_classes + 4, F.slice(head, 5, n_classes))
    best = F.array_max(scores)
    r = F.when(ratio > 0, ratio).otherwise(1.0)
    side = lambda c, s, pad, sign: (head[c] + sign * head[s] / 2 - pad) / r
    return {"cls": (F.array_position(scores, best) - 1).cast("int"), "score": best, "x1": side(0, 2, pad_x, -1), "y1": side(1, 3, pad_y, -1), "x2": side(0, 2, pad_x, 1), "y2": side(1, 3, pad_y, 1)}


def crop_reason(min_side: Column, det_score: Column, blur: Column, brightness: Column, over: Column, under: Column, least_side: float = 40, least_score: float = 0.5, least_blur: float = 20.0, bright: float = 215.0, dark: float = 40.0) -> Column:
    """Why a face crop isn't good enough; null if it is."""
    return (
        F.when(min_side <= 0, "face_crop_empty")
        .when(min_side < least_side, "face_too_small")
        .when(det_score < least_score, "low_detection_confidence")
        .when(blur < least_blur, "blurry")
        .when((brightness > bright) | (over > 0.35), "overexposed")
        .when((brightness < dark) | (under > 0.5), "underexposed")
    )


def crop_quality(min_side: Column, det_score: Column, blur: Column, brightness: Column, least_side: float = 40) -> Column:
    """0 to 1: size, sharpness, exposure and detector score weighed .3, .3, .2, .2."""
    exposure = F.greatest(F.lit(0.0), 1.0 - F.abs(brightness - 128.0) / 128.0)
    score = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), det_score)), F.lit(1.0))
    return 0.3 * F.least(F.lit(1.0), min_side / (least_side * 3.0)) + 0.3 * F.least(F.lit(1.0), blur / 200.0) + 0.2 * exposure + 0.2 * score


def engineering_notes(n: Mapping[str, Column], unknown: Column, total: Column) -> Column:
    """Codes of what an inventory calls for, from counts by class (a class that is not given counts 0)."""
    g = lambda c: n.get(c, F.lit(0))
    ratio = F.try_divide(unknown, total)
    rules = (
        ((g("contactor") > 0) & (g("overload_relay") > 0) & (g("overload_relay") < g("contactor")), "overload_mismatch"),
        ((g("vfd") > 0) & (g("cooling_fan") == 0), "drive_without_cooling"),
        ((g("plc") > 0) & (g("power_supply") == 0), "controller_without_supply"),
        ((g("power_supply") > 0) & (g("mcb") + g("fuse") + g("fuse_holder") == 0), "supply_unprotected"),
        ((g("emergency_stop") > 0) & (g("safety_relay") == 0), "stop_without_safety_relay"),
        ((g("safety_relay") > 0) & (g("emergency_stop") == 0), "safety_relay_without_stop"),
        ((g("current_transformer") > 0) & (g("energy_meter") + g("ammeter") + g("protection_relay") == 0), "transformer_without_meter"),
        ((g("capacitor") > 0) & (g("pf_controller") == 0), "capacitor_without_controller"),
        ((g("earth_bar") == 0) & (total >= 5), "no_earth_bar"),
        ((g("terminal_block") > 0) & (g("wire_duct") == 0) & (total >= 8), "no_wire_duct"),
        (ratio >= 0.30, "many_unknown"),
        ((ratio > 0) & (ratio < 0.30), "some_unknown"),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))


def purpose(class_id: Column, near: Column) -> Column:
    """What a device is for, from its class and the classes around it."""
    has = lambda *names: F.arrays_overlap(near, F.array(*map(F.lit, names)))
    return (
        F.when(class_id == "contactor", F.when(has("overload_relay", "motor_starter"), "motor_starter").when(has("capacitor"), "capacitor_stage").when(has("timer_relay"), "timed_load").otherwise("load_switching"))
        .when(class_id == "overload_relay", "motor_protection")
        .when(class_id == "mcb", F.when(has("power_supply", "plc"), "control_supply_protection").otherwise("final_circuit_protection"))
        .when(class_id == "mccb", F.when(has("vfd", "soft_starter"), "drive_input_protection").otherwise("feeder_protection"))
        .when(class_id == "vfd", F.when(has("line_reactor"), "speed_control_with_reactor").otherwise("speed_control"))
        .when(class_id == "plc", F.when(has("hmi"), "controller_with_panel").otherwise("controller"))
        .when(class_id == "relay", F.when(has("plc", "io_module"), "interposing").otherwise("auxiliary"))
        .when(class_id == "timer_relay", F.when(has("contactor"), "sequencing").otherwise("timing"))
        .when(class_id == "current_transformer", F.when(has("energy_meter", "ammeter"), "meter_input").otherwise("measurement"))
        .when(class_id == "terminal_block", "field_wiring")
        .otherwise("general")
    )


def corroborated(confidence: Column, agrees: Column) -> Column:
    """Confidence raised half way to 1, up to .995, where text on the device agrees with its class."""
    return F.when(agrees, F.least(F.lit(0.995), confidence + (1 - confidence) / 2)).otherwise(confidence)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays, from 0 (opposite) to 1; 1 for two constant ones."""
    n = F.size(a)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    ma, mb = total(a) / n, total(b) / n
    cov = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    va, vb = total(F.transform(a, lambda x: (x - ma) * (x - ma))), total(F.transform(b, lambda x: (x - mb) * (x - mb)))
    return (F.coalesce(F.try_divide(cov, F.sqrt(va * vb)), F.lit(1.0)) + 1) / 2


def nearest_colour(r: Column, g: Column, b: Column, palette: Mapping[str, tuple[int, int, int]]) -> Column:
    """Name of the palette colour at the least distance; of equals the first."""
    found = F.array(*[F.struct((F.pow(r - p[0], 2) + F.pow(g - p[1], 2) + F.pow(b - p[2], 2)).alias("d"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, p) in enumerate(palette.items())])
    return F.array_min(found)["n"]


def grid_hash(grid: Column, width: int, height: int) -> Column:
    """Gradient bits of a luminance grid of ``width`` + 1 by ``height`` values, row by row: is a value above its right neighbour?"""
    cells = [(y * (width + 1) + x, y * width + x) for y in range(height) for x in range(width)]
    out = F.lit(0).cast("long")
    for at, bit in cells:
        out = out.bitwiseOR(F.when(grid[at] > grid[at + 1], F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def mean_hash(grid: Column, size: int) -> Column:
    """Bits of a luminance grid: is a value above the mean?"""
    mean = F.aggregate(grid, F.lit(0.0), lambda s, x: s + x) / F.size(grid)
    out = F.lit(0).cast("long")
    for bit in range(size):
        out = out.bitwiseOR(F.when(grid[bit] > mean, F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out
