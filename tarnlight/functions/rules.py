"""Business rules as column expressions (F1-F14, F17-F24, F31-F37, F40-F45, F47). No Python functions run on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlight.functions import fixed as K


def let(x: Column, f) -> Column:
    """``f(x)`` with x evaluated once, where f names it several times and rules build on rules: else plans grow with 3^n."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def rounded(x: Column, digits: int) -> Column:
    """Half up by decimal value: what lies within 1e-9 below a half counts as one, whatever its binary form."""
    return F.round(x + F.lit(1e-9), digits)


def clamp(x: Column) -> Column:
    """to 0..100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def risk_level(score: Column) -> Column:
    """up to 15 low, up to 35 moderate, else high. Null stays null."""
    return F.when(score <= K.LOW_MAX, "low").when(score <= K.MODERATE_MAX, "moderate").when(score.isNotNull(), "high")


def composite(algae: Column, foam: Column, clarity: Column, fu_quality: Column, oil: Column, color: Column, debris: Column) -> Column:
    """F2: struct of score (1 dp), level of the unrounded sum, and the seven contributions (2 dp)."""
    inputs = {
        "algae": clamp(algae), "foam": clamp(foam), "turbidity": F.lit(100.0) - clamp(clarity), "forel_ule": F.lit(100.0) - clamp(fu_quality),
        "oil_sheen": clamp(oil), "color_abnormality": clamp(color), "debris": clamp(debris),
    }
    parts = {k: x * F.lit(K.WEIGHTS[k]) for k, x in inputs.items()}
    total = clamp(reduce(lambda a, b: a + b, parts.values()))
    return F.struct(
        rounded(total, 1).alias("composite_score"), risk_level(total).alias("risk_level"),
        F.struct(*[rounded(x, 2).alias(f"{k}_component") for k, x in parts.items()]).alias("breakdown"),
    )


def _boost(score: Column, by: Column) -> Column:
    return rounded(F.least(F.lit(100.0), score + by), 1)


def fuse(score: Column, prediction: Column, confidence: Column, p_bad: Column, second: Column, second_confidence: Column, third_confidence: Column | None = None) -> Column:
    """model outputs on top of a composite score; each step is capped at 100 and rounded to 1 dp.

    A confident 'bad' adds its probability, then the second model's and the third's signals; a confident 'good' adds
    nothing; otherwise the second model decides where it is confident. Null predictions are absent models.
    """
    second = F.coalesce(second, F.lit(""))
    bad = _boost(score, p_bad * 25)
    bad = F.when(second == "polluted", _boost(bad, second_confidence * 30)).when(second == "turbid", _boost(bad, second_confidence * 15)).otherwise(bad)
    if third_confidence is not None:
        bad = F.when(F.coalesce(third_confidence, F.lit(0.0)) > 0.5, _boost(bad, third_confidence * 15)).otherwise(bad)
    sure = second_confidence > 0.7
    unsure = F.when((second == "polluted") & sure, _boost(score, second_confidence * 20)).when((second == "turbid") & sure, _boost(score, second_confidence * 10)).otherwise(score)
    return F.when((prediction == "bad") & (confidence > 0.70), bad).when((prediction == "good") & (confidence > 0.85), score).otherwise(unsure)


def fuse_baseline(score: Column, prediction: Column, confidence: Column, p_bad: Column, second: Column, second_confidence: Column) -> Column:
    """the evaluation variant: only a confident 'bad' counts, nothing is rounded."""
    add = p_bad * 25 + F.when(second == "polluted", second_confidence * 30).when(second == "turbid", second_confidence * 15).otherwise(F.lit(0.0))
    return F.when((prediction == "bad") & (confidence > 0.70), F.least(F.lit(100.0), score + add)).otherwise(score)


def safety_net(score: Column, foam: Column, debris: Column, algae: Column) -> Column:
    """strong visual signals lift a score below 36 to 36 and more."""
    strong = ((foam > 30) | (debris > 30) | (algae > 50)) & (score < 36)
    least = F.lit(36.0) + foam * 0.15 + debris * 0.1
    return F.when(strong, rounded(F.least(F.lit(100.0), F.greatest(score, least)), 1)).otherwise(score)


def fu_name(index: Column) -> Column:
    """F7"""
    return F.when(index.between(1, 21), F.try_element_at(F.lit(list(K.FU_NAMES)), index)).otherwise("Unknown")


def fu_quality(index: Column) -> Column:
    """F8"""
    return F.round(F.lit(100.0) - (F.least(F.lit(21), F.greatest(F.lit(1), index)) - 1) / 20 * 100, 1)


def fu_category(index: Column) -> Column:
    """F9"""
    out = F.lit("unknown")
    for name, top in reversed(K.FU_CATEGORIES):
        out = F.when((index >= 1) & (index <= top), name).otherwise(out)
    return out


def nearest_fu(r: Column, g: Column, b: Column) -> Column:
    """The index of the nearest palette colour by Euclidean distance, the first of equals. Squares order alike."""
    away = [F.struct((F.pow(r - x, 2) + F.pow(g - y, 2) + F.pow(b - z, 2)).alias("d"), F.lit(i).alias("i")) for i, (x, y, z) in enumerate(K.FU_RGB, 1)]
    return F.array_min(F.array(*away))["i"]


def algae_severity(pct: Column) -> Column:
    """F10"""
    return F.when(pct < 5, "none").when(pct < 20, "low").when(pct < 50, "moderate").otherwise("heavy")


def clarity(laplacian: Column, s_std: Column, v_std: Column, v_mean: Column) -> Column:
    """struct of score and description."""
    penalty = F.when(s_std > 40, F.least(F.lit(50.0), (s_std - 40) * 1.5)).otherwise(F.lit(0.0))
    penalty += F.when(v_std > 50, F.least(F.lit(30.0), v_std - 50)).otherwise(F.lit(0.0))
    penalty += F.when(v_mean < 100, F.least(F.lit(40.0), (F.lit(100.0) - v_mean) * 0.8)).otherwise(F.lit(0.0))
    penalty += F.when((laplacian > 150) & (v_mean < 130), 25.0).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), laplacian / 300.0 * 100) - penalty)
    told = F.when(score > 66, "Clear").when(score > 33, "Moderately Turbid").otherwise("Highly Turbid")
    return F.struct(rounded(score, 1).alias("turbidity_score"), told.alias("clarity_description"))


def oil_type(slick: Column, rainbow: Column) -> Column:
    """F12"""
    return F.when((slick > rainbow) & (slick > 2), "thick slick").when(rainbow > 1, "rainbow sheen").otherwise("none")


def oil_confidence(coverage: Column) -> Column:
    """F12"""
    return F.when(coverage < 1, "none").when(coverage < 5, "possible").otherwise("likely")


def color_abnormality(hue_std: Column, unnatural: Column) -> Column:
    """struct of score, uniformity and description."""
    uniform = F.greatest(F.lit(0.0), F.lit(100.0) - hue_std / 60.0 * 100)
    score = clamp((F.lit(100.0) - uniform) * 0.6 + F.least(unnatural * 5, F.lit(100.0)) * 0.4)
    told = F.when(score < 20, "Normal").when(score < 50, "Slightly Abnormal").otherwise("Highly Abnormal")
    return F.struct(rounded(score, 1).alias("color_abnormality_score"), rounded(uniform, 1).alias("color_uniformity"), told.alias("description"))


def debris(density: Column) -> Column:
    """struct of score, detected and description from the covered share in per cent."""
    score = F.least(F.lit(100.0), density / 30.0 * 100)
    told = F.when(score < 10, "Clean Surface").when(score < 30, "Some Debris").when(score < 60, "Moderate Debris").otherwise("Heavy Debris")
    return F.struct(rounded(score, 1).alias("contour_density"), (score >= 10).alias("debris_detected"), told.alias("description"))


def corroboration(available: Column, self_anomaly: Column, exceeds: Column) -> Column:
    """null flags are false."""
    a, b = F.coalesce(self_anomaly, F.lit(False)), F.coalesce(exceeds, F.lit(False))
    return F.when(~F.coalesce(available, F.lit(False)), "unavailable").when(a & b, "elevated").when(a | b, "watch").otherwise("nominal")


def spatial_confidence(buffer_m: Column) -> Column:
    """F18"""
    return F.when(buffer_m <= K.BUFFERS[0], "high").when(buffer_m <= 300, "medium").when(buffer_m.isNotNull(), "low")


def satellite_columns(live: Column, latest: Column, available: Column) -> dict[str, Column]:
    """what enrichment writes to a report."""
    return {"satellite_ndci": F.coalesce(live, latest), "satellite_status": F.when(F.coalesce(available, F.lit(False)), "done").otherwise("unavailable")}


def unavailable_reason(n_scenes: Column) -> Column:
    """why a point query gave nothing."""
    return F.when(F.coalesce(n_scenes, F.lit(0)) == 0, "cloud_cover_or_timeout").otherwise("sub_pixel_or_no_water")


def baseline_ratio(latest: Column, baseline: Column) -> Column:
    """3 dp, null near a zero baseline."""
    return F.when(F.abs(baseline) > 1e-6, F.round(latest / baseline, 3))


def badge(status: Column, confidence: Column, exceeds: Column, verdict: Column) -> Column:
    """what the dashboard shows; an own anomaly alone shows as nominal there."""
    shown = F.when(F.coalesce(exceeds, F.lit(False)), F.when(F.coalesce(verdict, F.lit("")) == "elevated", "elevated").otherwise("watch")).otherwise("nominal")
    gone = (status != "done") | F.coalesce(confidence == "low", F.lit(False))
    return F.when(status.isNull() | status.isin("pending", "processing"), "processing").when(gone, "unavailable").otherwise(shown)


def level_rank(level: Column, unknown: int) -> Column:
    return F.when(level == "low", 0).when(level == "moderate", 1).when(level == "high", 2).otherwise(unknown)


def meets_threshold(level: Column, least: Column) -> Column:
    """unknown levels rank 0, an unknown least level 2."""
    return level_rank(level, 0) >= level_rank(least, 2)


def relative_age(then: Column, now: Column) -> Column:
    """F24"""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    of = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(then.isNull(), "Unknown").when(s < 60, of(1, "s")).when(s < 3600, of(60, "m")).when(s < 86400, of(3600, "h")).otherwise(of(86400, "d"))


def lake_key(name: Column) -> Column:
    """lower case, without 'reservoir' and 'lake', one space between words."""
    short = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "reservoir", ""), "lake", "")
    return F.trim(F.regexp_replace(short, r"\s+", " "))


def slug(text: Column) -> Column:
    """F26"""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_tags(html: Column) -> Column:
    """F27"""
    return F.trim(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", ""))


def stem(text: Column) -> Column:
    """the first twelve characters of the SHA-1 as a file stem."""
    return F.substring(F.sha1(text), 1, 12)


def hex_code(hexa: Column) -> Column:
    """16 hexadecimal digits as a signed 64-bit code, what is no hexadecimal number as 0."""
    good = hexa.rlike("^[0-9a-fA-F]{1,16}$")
    return F.when(good, F.conv(hexa, 16, -10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def code_hex(code: Column) -> Column:
    """F29"""
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    """F30"""
    return F.bit_count(a.bitwiseXOR(b))


def binary_label(name: Column) -> Column:
    """1 for polluted, turbid, bad, moderate and high, 0 for clean, good and low, null for no opinion."""
    return F.when(name.isin("polluted", "turbid", "bad", "moderate", "high"), 1).when(name.isin("clean", "good", "low"), 0)


def three_class(level: Column) -> Column:
    """F31"""
    return F.when(level == "low", 0).when(level == "moderate", 1).when(level == "high", 2)


def vote(text: Column) -> Column:
    """A vote as an integer; blanks, EXCLUDE and what is no number are null."""
    return F.try_to_number(F.regexp_extract(F.trim(text), r"^(-?\d{1,9})(\.\d*)?$", 1), F.lit("S999999999")).cast("int")


def majority(votes: Column) -> Column:
    """F32: the most frequent vote, of equals the highest; nulls don't count."""
    known = F.filter(votes, lambda v: v.isNotNull())
    counted = F.transform(F.array_distinct(known), lambda v: F.struct(F.size(F.filter(known, lambda w: w == v)).alias("n"), v.alias("v")))
    return F.array_max(counted)["v"]


def final_label(consensus: Column, final: Column, votes: Column) -> Column:
    """F32: consensus, else final, else the majority; only 0, 1 and 2 are labels."""
    label = F.coalesce(consensus, final, majority(votes))
    return F.when(label.isin(0, 1, 2), label)


def mode_first(a: Column, b: Column, c: Column) -> Column:
    """the mode of three votes, the first seen of equals."""
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(a)


def leakage_level(pct: Column) -> Column:
    """by the per cent of suspiciously near rows."""
    return F.when(pct > 10, "SEVERE").when(pct > 2, "MODERATE").when(pct > 0, "MINIMAL").otherwise("NONE")


def cluster_risk(singleton_pct: Column) -> Column:
    """HIGH where few items stand alone, LOW where nearly all do."""
    return F.when(singleton_pct < 50, "HIGH").when(singleton_pct > 90, "LOW").otherwise("MODERATE")


def ood_verdict(gap_pp: Column) -> Column:
    """F35"""
    return F.when(gap_pp > 15, "SIGNIFICANT").when(gap_pp > 5, "MODERATE").otherwise("MINIMAL")


def auc_reading(auc: Column) -> Column:
    """F35"""
    return F.when(auc < 0.60, "near chance").when(auc < 0.75, "weak").otherwise("useful")


def ensemble_verdict(delta_pp: Column) -> Column:
    """F36"""
    return F.when(delta_pp > 2, "ensemble better").when(delta_pp < -2, "ensemble worse").otherwise("about equal")


def sanity_flags(high_pct: Column, low_pct: Column, bad_pct: Column) -> Column:
    """F37"""
    return F.array_compact(F.array(F.when(high_pct > 85, "over-predicts high"), F.when(low_pct > 85, "under-predicts"), F.when(bad_pct > 90, "over-confident bad")))


def first_filled(*columns: Column) -> Column:
    """the first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def evidence_status(*columns: Column) -> Column:
    """F39"""
    return F.when(first_filled(*columns).isNotNull(), "documented").otherwise("missing")


def top_detection(found: Column) -> Column:
    """the detection of the highest confidence, the first of equals."""
    return F.array_max(F.transform(found, lambda d, i: F.struct(d["confidence"].alias("confidence"), (-i).alias("i"), d["class"].alias("class"))))


def pollution_confidence(found: Column) -> Column:
    """F41"""
    return F.coalesce(F.array_max(F.transform(F.filter(found, lambda d: d["class"].isin("polluted", "algae")), lambda d: d["confidence"])), F.lit(0.0))


def detection_summary(top: Column, n: Column) -> Column:
    """F42"""
    return F.format_string("%d detections, top %s %.0f%%", n, top["class"], F.round(top["confidence"] * 100, 0))


def class_counts(found: Column) -> Column:
    """A map from class to number, classes in order."""
    names = F.array_sort(F.array_distinct(F.transform(found, lambda d: d["class"])))
    return F.map_from_entries(F.transform(names, lambda c: F.struct(c, F.size(F.filter(found, lambda d: d["class"] == c)).cast("bigint"))))


def display_title(name: Column) -> Column:
    """F44"""
    plain = F.replace(name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1_000_000))


def reporter(name: Column) -> Column:
    """F44"""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("Anonymous"))


def unnamed(lat: Column, lon: Column) -> Column:
    """F45"""
    return F.format_string("Unnamed Water Body (%.4f, %.4f)", lat, lon)


def audit_conclusion(level: Column, before: Column, after: Column) -> Column:
    """whether a group-aware split cost accuracy, in words. Null inputs are an audit that has not been run."""
    drop = (before - after) * 100
    kept = F.format_string("Leakage %s; accuracy fell by %.1f points, less than 2: the reported accuracy holds.", level, drop)
    lost = F.format_string("Leakage %s; accuracy fell by %.1f points: report the group-aware accuracy.", level, drop)
    return F.when(level.isNull() | drop.isNull(), "Not run.").when(drop < 2, kept).otherwise(lost)
