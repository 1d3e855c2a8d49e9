"""Uploads, capture sources, image-quality gate and per-image metric summaries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuvet import fixed
from docuvet.functions.numbers import dec
from docuvet.functions.text import contains_any, first_non_empty
from docuvet.params import GateParams


def admit_uploads(files: DataFrame) -> DataFrame:
    """Add ``reject_reason``: wrong type, empty or too large; NULL for accepted files."""
    name = F.coalesce(first_non_empty(F.col("filename")), F.lit("uploaded_document.jpg"))
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return files.withColumn(
        "reject_reason",
        F.when(~extension.isin(*fixed.ALLOWED_EXTENSIONS), "UNSUPPORTED_TYPE")
        .when(F.col("size_bytes") == 0, "EMPTY_FILE")
        .when(F.col("size_bytes") > fixed.MAX_UPLOAD_BYTES, "TOO_LARGE"),
    )


def mime_from_name(filename: Column) -> Column:
    return F.when(filename.rlike(r"(?i)\.jpe?g$"), "image/jpeg").otherwise("image/png")


def _ratio_within(low: int, high: int) -> Column:
    """Aspect ratio in a closed range of hundredths, by multiplication so that nothing is rounded."""
    times = lambda name, n: F.col(name) * F.lit(n).cast("long")
    return (times("_long", 100) >= times("_short", low)) & (times("_long", 100) <= times("_short", high))


def with_source(images: DataFrame) -> DataFrame:
    """Classify the capture source from names, metadata and pixel statistics.

    What several tests share is a column first: written out in each test, the rule grows beyond the method size that the JVM compiles.
    """
    shared = {
        "_name": F.lower(F.coalesce("filename", F.lit(""))), "_software": F.lower(F.coalesce("software", F.lit(""))),
        "_exif": F.coalesce("has_camera_exif", F.lit(False)),
        "_long": F.greatest("width", "height"), "_short": F.greatest(F.lit(1), F.least("width", "height")),
    }
    images = images.withColumns(shared).withColumn("_screen", _ratio_within(175, 225) | _ratio_within(158, 180) | _ratio_within(130, 136))
    name, software, exif, screen_ratio = F.col("_name"), F.col("_software"), F.col("_exif"), F.col("_screen")
    white, noise = F.col("white_ratio"), F.col("white_std")
    pdf = F.endswith(name, F.lit(".pdf")) | F.lower(F.coalesce("mime_type", F.lit(""))).contains("pdf")
    screenshot = (
        contains_any(name, fixed.SCREENSHOT_NAMES) | contains_any(software, fixed.SCREENSHOT_SOFTWARE)
        | (screen_ratio & (white > dec("0.30")) & (noise < dec("1.2")) & ~exif)
    )
    digital = ((white > dec("0.35")) & (noise < dec("1.5")) & ~exif) | (
        (F.col("color_sparsity") < dec("0.08")) & (F.col("p99_gradient") > 1200)
    )
    scanned = contains_any(software, fixed.SCANNER_SOFTWARE) | (
        (white > dec("0.40")) & (noise < dec("3.5")) & ~exif & ~screen_ratio
    )
    df = images.withColumn(
        "source_type",
        F.when(pdf, "DIGITAL_PDF").when(screenshot, "SCREENSHOT").when(digital, "DIGITAL_IMAGE")
        .when(scanned, "SCANNED_DOCUMENT").otherwise("PHYSICAL_CAPTURE"),
    )
    kind = F.col("source_type")
    physical = kind == "PHYSICAL_CAPTURE"
    return df.withColumns(
        {
            "is_digital": kind.isin("DIGITAL_PDF", "SCREENSHOT", "DIGITAL_IMAGE"),
            "glare_applicable": physical,
            "blur_applicable": kind.isin("SCANNED_DOCUMENT", "PHYSICAL_CAPTURE"),
            "source_confidence": F.when(kind == "DIGITAL_PDF", dec("1.00", 3, 2))
            .when(kind == "SCREENSHOT", dec("0.95", 3, 2))
            .when(kind == "DIGITAL_IMAGE", dec("0.92", 3, 2))
            .when(kind == "SCANNED_DOCUMENT", dec("0.88", 3, 2))
            .otherwise(F.when(exif, dec("0.90", 3, 2)).otherwise(dec("0.75", 3, 2))),
        }
    ).drop(*shared, "_screen")


def refine_source(df: DataFrame) -> DataFrame:
    """Name electronic identity documents and passport scans once the document type is known."""
    kind, doc = F.col("source_type"), F.coalesce("document_type", F.lit(""))
    refined = (
        F.when(F.col("is_digital") & doc.contains("AADHAAR"), "E_AADHAAR")
        .when(F.col("is_digital") & doc.contains("PAN"), "E_PAN")
        .when((kind == "SCANNED_DOCUMENT") & (doc == fixed.PASSPORT), "PASSPORT_SCAN")
        .otherwise(kind)
    )
    df = df.withColumn("source_type", refined)
    shown = None
    for key, name in fixed.SOURCE_NAMES.items():
        hit = F.col("source_type") == key
        shown = F.when(hit, name) if shown is None else shown.when(hit, name)
    return df.withColumn("source_display", shown)


def cropped_edges(params: GateParams = GateParams()) -> Column:
    """Names of the border strips whose content runs over the edge."""
    strips = F.array(*[F.struct(F.lit(s).alias("name"), F.col(f"{s}_std").alias("std")) for s in ("top", "bottom", "left", "right")])
    return F.transform(F.filter(strips, lambda s: s["std"] > params.edge_std), lambda s: s["name"])


def _note(condition: Column, code: str, *parts) -> Column:
    return F.when(condition, F.concat(F.lit(code + " "), *parts))


def quality_gate(images: DataFrame, params: GateParams = GateParams()) -> DataFrame:
    """Add issues, warnings and the gate status; needs the columns of ``with_source``."""
    p = params
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    low = (F.col("width") < p.min_width) | (F.col("height") < p.min_height)
    small = (F.col("width") < p.recommended_width) | (F.col("height") < p.recommended_height)
    optical = ~F.col("is_digital")
    blur_applies, glare_applies = F.col("blur_applicable") & optical, F.col("glare_applicable") & optical
    one = lambda c: F.round(F.col(c), 1).cast("decimal(9,1)").cast("string")
    washed = optical & (F.col("luminance") > p.max_luminance) & (F.col("contrast") < p.washed_out_contrast)
    edges = F.col("cropped_edges")
    df = images.withColumn("cropped_edges", F.when(optical, cropped_edges(p)).otherwise(F.array().cast("array<string>")))
    found = [
        _note(low, "LOW_RESOLUTION", size),
        _note(blur_applies & (F.col("blur") < p.min_blur), "SEVERE_BLUR", one("blur")),
        _note(F.col("luminance") < p.min_luminance, "TOO_DARK", one("luminance")),
        _note(washed, "WASHED_OUT", one("luminance")),
        _note(glare_applies & (F.col("glare_ratio") > p.max_glare), "GLARE", F.round(F.col("glare_ratio") * 100, 1).cast("decimal(9,1)").cast("string")),
    ]
    issues = F.array_compact(F.array(*found))
    warnings = F.array_compact(
        F.array(
            _note(~low & small, "SMALL_RESOLUTION", size),
            _note(blur_applies & (F.col("blur") >= p.min_blur) & (F.col("blur") < p.warning_blur), "MODERATE_BLUR", one("blur")),
            _note(optical & (F.abs("skew_deg") > p.max_skew), "SKEWED", one("skew_deg")),
            _note(F.size(edges) >= p.min_cropped_edges, "CROPPED", F.array_join(edges, ", ")),
        )
    )
    # The status asks for any issue, so that it needs no array where the issues are not read.
    status = F.when(F.coalesce(*found).isNotNull(), "RECAPTURE_REQUIRED").otherwise("PASSED")
    return df.withColumns({"gate_issues": issues, "gate_warnings": warnings, "gate_status": status})


def glare_ratio(blobs: DataFrame) -> DataFrame:
    """Share of each image covered by compact saturated blobs."""
    compact = (F.col("area") > 100) & (F.col("w") * 10 < F.col("img_w") * 7) & (F.col("h") * 10 < F.col("img_h") * 7)
    return blobs.groupBy("image_id").agg(
        F.sum(F.when(compact, F.col("area")).otherwise(0)).alias("glare_pixels"),
        F.max(F.greatest(F.lit(1), F.col("img_w") * F.col("img_h"))).alias("pixels"),
    ).withColumn("glare_ratio", F.col("glare_pixels").cast("double") / F.col("pixels").cast("double"))


def _first_rows(rows: DataFrame, key: str, order: list, count: int) -> DataFrame:
    """First rows per key. Spark keeps only ``count`` rows per key and task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= count)


def skew_angle(lines: DataFrame, order: list) -> DataFrame:
    """Median angle of the first fifteen lines of an image, folded to within 45 degrees."""
    angle = F.col("angle")
    folded = F.when(F.abs(angle) < 45, angle).when(angle > 45, angle - 90).when(angle < -45, angle + 90)
    first = _first_rows(lines, "image_id", order, 15)
    return first.groupBy("image_id").agg(F.coalesce(F.median(folded), F.lit(0.0)).alias("skew_deg"))


def top_regions(regions: DataFrame, order: list, count: int = 4) -> DataFrame:
    """First anomaly boxes above half a percent of the image, in percent of its size."""
    large = regions.filter(F.col("w") * F.col("h") * 200 > F.col("img_w") * F.col("img_h"))
    percent = lambda value, base: F.round(dec(F.col(value) * 100) / dec(F.col(base), 9, 0), 1).cast("decimal(9,1)")
    first = _first_rows(large, "image_id", order, count)
    return first.select(
        "image_id", F.concat(F.lit("sr_"), F.col("_pos").cast("string")).alias("id"),
        percent("x", "img_w").alias("x_pct"), percent("y", "img_h").alias("y_pct"),
        percent("w", "img_w").alias("w_pct"), percent("h", "img_h").alias("h_pct"),
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated percentiles of a metric with a fixed number of decimals.

    Values are counted first, so a group of any size reaches the window as its distinct
    values only (the range of the metric in steps of its last decimal).
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumns(
        {"_upto": F.sum("_n").over(whole.orderBy(value)), "_total": F.sum("_n").over(whole)}
    )
    found = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_total") - 1)
        found.append(F.min(F.when(F.col("_upto") > F.floor(place), F.col(value))).cast("double").alias(f"_{name}_low"))
        found.append(F.min(F.when(F.col("_upto") > F.ceil(place), F.col(value))).cast("double").alias(f"_{name}_high"))
        found.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
    summary = ranked.groupBy(*keys).agg(F.max("_total").alias("n"), *found)
    return summary.select(
        *keys, "n",
        *[
            (F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")).alias(n) for n in shares
        ],
    )
