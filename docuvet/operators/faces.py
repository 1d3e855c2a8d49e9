"""Portrait against selfie: similarity of embeddings, calibration and verdict."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuvet.functions.numbers import clamp, dec, round1
from docuvet.params import FaceParams


def _sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _products(a: Column, b: Column) -> Column:
    return _sum_of(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    return _products(a, b) / F.sqrt(_products(a, a) * _products(b, b))


def normalized_l2(a: Column, b: Column) -> Column:
    """Distance of the two vectors after scaling both to unit length."""
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - cosine_similarity(a, b) * 2))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of equal length."""
    n = F.size(a).cast("double")
    mean_a, mean_b = _sum_of(F.transform(a, lambda x: x.cast("double"))) / n, _sum_of(F.transform(b, lambda x: x.cast("double"))) / n
    top = _products(a, b) - n * mean_a * mean_b
    return top / F.sqrt((_products(a, a) - n * mean_a * mean_a) * (_products(b, b) - n * mean_b * mean_b))


def calibrate_similarity(cosine: Column, params: FaceParams = FaceParams()) -> Column:
    """Percentage with 70.0 at the pass cosine."""
    p = params
    above = F.least(F.lit(99.5), F.lit(70.0) + (cosine - p.cosine_pass) / (p.cosine_full - p.cosine_pass) * 29.5)
    below = F.greatest(F.lit(10.0), cosine / p.cosine_pass * 69.9)
    return round1(F.when(cosine >= p.cosine_pass, above).otherwise(below))


def histogram_similarity(a: Column, b: Column) -> Column:
    """Fallback percentage from the correlation of two histograms."""
    return round1(clamp(F.lit(50.0) + correlation(a, b) * 45.0, 30, 95))


def primary_faces(boxes: DataFrame, params: FaceParams = FaceParams()) -> DataFrame:
    """Number of large enough faces per image, and the first of them."""
    ok = (F.col("width") >= params.min_face_px) & (F.col("height") >= params.min_face_px)
    box = F.struct("seq", "width", "height")
    return boxes.groupBy("image_id").agg(
        F.count_if(ok).alias("face_count"), F.min_by(F.when(ok, box), F.when(ok, F.struct("seq", "width", "height"))).alias("face")
    )


def crop_quality(params: FaceParams = FaceParams()) -> dict[str, Column]:
    blur, light = F.col("blur"), F.col("luminance")
    sharp, lit = blur >= params.min_crop_blur, light.between(params.min_crop_luminance, params.max_crop_luminance)
    return {
        "crop_passed": sharp & lit, "is_blurry": ~sharp, "is_dark": light < params.min_crop_luminance,
        "is_overexposed": light > params.max_crop_luminance,
    }


def one_face(faces: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """The first face of each case by ``order``, or by a hash of the row where none is given."""
    rest = [c for c in faces.columns if c != "case_id"]
    first = F.min_by(F.struct(*rest), F.struct(*order) if order else F.xxhash64(*rest))
    return faces.groupBy("case_id").agg(first.alias("f")).select("case_id", *[F.col(f"f.{c}") for c in rest])


def face_pairs(portraits: DataFrame, selfies: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """One portrait and one selfie per case, with the similarity of their embeddings.

    Both sides are reduced to one face first; the aggregation and the join share their key and so one exchange a side.
    """
    pairs = one_face(portraits, order).drop(*order).join(one_face(selfies, order).drop(*order), "case_id")
    return pairs.withColumn("cosine", cosine_similarity(F.col("doc_embedding"), F.col("selfie_embedding"))).withColumn(
        "similarity", calibrate_similarity(F.col("cosine"))
    )


def with_face_verdict(pairs: DataFrame, params: FaceParams = FaceParams()) -> DataFrame:
    """Error cascade, status, confidence and details of each comparison.

    NULL counts stand for an image that could not be decoded.
    """
    docs, selfies, s = F.col("doc_face_count"), F.col("selfie_face_count"), F.col("similarity")
    error = (
        F.when(docs.isNull(), "INVALID_DOC_IMAGE")
        .when(selfies.isNull(), "INVALID_SELFIE_IMAGE")
        .when(docs == 0, "NO_DOC_FACE")
        .when(selfies == 0, "NO_SELFIE_FACE")
        .when(selfies > 1, "MULTIPLE_SELFIE_FACES")
    )
    df = pairs.withColumn("input_error", error)
    compared = F.col("input_error").isNull()
    passed = compared & (s >= params.pass_mark)
    detail = lambda metric, score, ok: F.struct(
        F.lit(metric).alias("metric"), round1(score if isinstance(score, Column) else dec(score)).alias("score"),
        F.when(ok if isinstance(ok, Column) else F.lit(ok), "PASS").otherwise("FAIL").alias("status"),
    )
    doc_found = detail("Document Face Detection", 100, True)
    details = (
        F.when(F.col("input_error") == "NO_DOC_FACE", F.array(detail("Document Face Isolation", 0, False)))
        .when(F.col("input_error") == "NO_SELFIE_FACE", F.array(doc_found, detail("Selfie Face Detection", 0, False)))
        .when(F.col("input_error") == "MULTIPLE_SELFIE_FACES", F.array(doc_found, detail("Selfie Face Isolation", 0, False)))
        .when(compared, F.array(
            detail("Document Face Quality", 96, True), detail("Live Selfie Resolution & Lighting", 92, True),
            detail("Deep 128D Embedding Similarity", s, passed)))
    )
    confidence = F.when(passed, dec((s - params.pass_mark) * dec("0.8", 2, 1)) + dec(75)).otherwise(dec(s * dec("0.9", 2, 1)))
    return df.withColumns(
        {
            "error_code": F.coalesce("input_error", F.when(~passed, "FACE_MISMATCH")),
            "face_status": F.when(passed, "PASSED").otherwise("FAILED"),
            "similarity": F.when(compared, s).otherwise(dec(0, 9, 1)),
            "match_confidence": F.when(compared, round1(clamp(confidence, 70, "99.8"))).otherwise(dec(0, 9, 1)),
            "face_details": details,
        }
    ).drop("input_error")
