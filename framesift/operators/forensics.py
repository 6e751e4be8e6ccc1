"""Byte-level signals: provenance markers, bit-plane statistics, hidden payloads, recompression error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers that are looked for in lower-cased bytes, and what they are reported as.
PROVIDERS = {
    "adobe firefly": "Adobe Firefly",
    "dall-e": "DALL-E",
    "gemini": "Google Gemini",
    "google ai": "Google AI",
    "google c2pa": "Google C2PA",
    "google generative ai": "Google Generative AI",
    "midjourney": "Midjourney",
    "stable diffusion": "Stable Diffusion",
}
AI_CLAIMS = {
    "added imperceptible synthid watermark": "Added imperceptible SynthID watermark",
    "algorithmicmedia": "Algorithmic media",
    "created by google generative ai": "Created by Google Generative AI",
    "trainedalgorithmicmedia": "Trained algorithmic media",
}
C2PA = ("c2pa", "content credentials", "jumb")
SCAN_BYTES = 8 << 20
# Fixed values of payload layouts.
PAYLOAD_MARK = "STEGv1:"
SIGNATURES = {"25504446": "PDF", "504B0304": "ZIP", "89504E470D0A1A0A": "PNG", "4D5A": "Windows executable"}
MOST_PAYLOAD = 64 << 10
PREVIEW = 160
#: Rows whose histograms are held at once.
SLICE = 256


def head_and_tail(content: Column, k: int = SCAN_BYTES) -> Column:
    """First and last k bytes put together; they overlap in files of under 2 k bytes."""
    return F.when(F.octet_length(content) > k, F.concat(F.substring(content, 1, k), F.substring(content, -k, k))).otherwise(content)


def provenance(content: Column, k: int = SCAN_BYTES) -> Column:
    """Struct of c2pa_markers, ai_claims and providers found, each in order and once."""
    text = F.lower(F.decode(head_and_tail(content, k), "ISO-8859-1"))
    names = lambda markers: F.array_sort(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(m)), n) for m, n in markers.items()])))
    c2pa = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(m)), m) for m in C2PA]))
    return F.struct(c2pa.alias("c2pa_markers"), names(AI_CLAIMS).alias("ai_claims"), names(PROVIDERS).alias("providers"), F.lit(False).alias("signature_verified"))


def histograms(rows: DataFrame, key: str, content: str, channels: int = 1) -> DataFrame:
    """key, channel, counts: how often each byte value stands at the places of each channel (place modulo
    channels); a row for each channel that has a byte. Counted inside the row's batch, SLICE rows at a time: nothing
    is shuffled, and counts of few rows are held at once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield counted(batch.slice(at, SLICE))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        which, channel, found = [], [], []
        for i, data in enumerate(batch.column(1).cast(pa.large_binary())):
            raw = np.frombuffer(data.as_buffer() or b"", np.uint8) if data.is_valid else np.zeros(0, np.uint8)
            for c in range(min(channels, len(raw))):
                which.append(i), channel.append(c), found.append(np.bincount(raw[c::channels], minlength=256))
        counts = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * 256, pa.int32()), pa.array(np.concatenate(found or [np.zeros(0, np.int64)])))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(channel, pa.int32()), counts], [key, "channel", "counts"])

    return rows.select(key, content).mapInArrow(count, f"{key} {rows.schema[key].dataType.simpleString()}, channel int, counts array<long>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def channel_statistics(counted: DataFrame, key: str) -> DataFrame:
    """Share of set lowest bits, and mean imbalance over the non-empty pairs of values 2 k, 2 k + 1, by channel.

    counted: key, channel, counts, as histograms gives them.
    """
    pair = lambda k: F.struct((F.get("counts", 2 * k) + F.get("counts", 2 * k + 1)).alias("n"), F.get("counts", 2 * k + 1).alias("ones"))
    paired = counted.select(key, "channel", F.filter(F.transform(F.sequence(F.lit(0), F.lit(127)), pair), lambda p: p["n"] > 0).alias("pairs"))
    ones, n = _total(F.transform("pairs", lambda p: p["ones"].cast("double"))), _total(F.transform("pairs", lambda p: p["n"].cast("double")))
    apart = _total(F.transform("pairs", lambda p: F.abs(p["n"] - 2 * p["ones"]) / p["n"])) / F.size("pairs")
    return paired.select(key, "channel", (ones / n).alias("ones_ratio"), apart.alias("pair_imbalance"))


def entropy(counted: DataFrame, key: str) -> DataFrame:
    """Shannon entropy in bits of the byte values of each row of histograms; never a negative zero."""
    some = F.transform(F.filter("counts", lambda n: n > 0), lambda n: n.cast("double"))
    # sum p log2 p = sum n log2 n / N - log2 N: one pass over the counts.
    parts = counted.select(key, _total(some).alias("n"), _total(F.transform(some, lambda n: n * F.log2(n))).alias("s"))
    return parts.select(key, F.greatest(F.log2("n") - F.col("s") / F.col("n"), F.lit(0.0)).alias("entropy"))


def payload(stream: Column) -> Column:
    """Struct of method and payload (binary) of a packed bit stream; nulls where no layout fits.

    A mark in the first 64 bytes decides alone, even over an empty payload; then a length prefix whose
    content has a signature or is mostly printable; then a signature at the start.
    """
    text = F.decode(F.substring(stream, 1, 1 << 24), "ISO-8859-1")
    n = F.octet_length(stream)
    mark = F.locate(PAYLOAD_MARK, F.substring(text, 1, 64))
    begin = mark + len(PAYLOAD_MARK)
    body = F.substr(text, begin, F.lit(MOST_PAYLOAD))
    stop = F.locate("\0", body)
    marked = F.when(stop > 0, F.substr(body, F.lit(1), stop - 1)).otherwise(body)
    length = F.conv(F.hex(F.substring(stream, 1, 4)), 16, 10).cast("long")
    fits = (n >= 8) & (length > 0) & (length <= F.least(F.lit(MOST_PAYLOAD), n - 4))
    prefixed = F.substr(stream, F.lit(5), length.cast("int"))
    signature = lambda b: F.coalesce(*[F.when(F.startswith(b, F.unhex(F.lit(h))), name) for h, name in SIGNATURES.items()])
    inner = F.substr(text, F.lit(5), length.cast("int"))
    printable = F.char_length(F.regexp_replace(inner, r"[^\x20-\x7E\r\n\t]", "")) / length
    sign = signature(prefixed)
    by_length = fits & (sign.isNotNull() | (printable >= 0.8))
    start = signature(stream)
    method = (
        F.when(mark > 0, "STEGv1 marker")
        .when(by_length, F.concat(F.lit("32-bit length prefix ("), F.coalesce(sign, F.lit("text-like payload")), F.lit(")")))
        .when(start.isNotNull(), F.concat(start, F.lit(" signature at LSB stream start")))
    )
    content = F.when(mark > 0, F.when(marked != "", F.encode(marked, "ISO-8859-1"))).when(by_length, prefixed).when(start.isNotNull(), F.substring(stream, 1, MOST_PAYLOAD))
    return F.struct(method.alias("method"), content.alias("payload"))


def preview(content: Column) -> Column:
    """First bytes as text, a dot for what can't be shown; null if there are none."""
    return F.nullif(F.regexp_replace(F.decode(F.substring(content, 1, PREVIEW), "ISO-8859-1"), r"[^ -~]", "."), F.lit(""))


def error_statistics(errors: DataFrame, key: str, error: str, threshold: int = 20) -> DataFrame:
    """Mean, exact 95th percentile, largest, and share at or over the threshold of each key's errors."""
    e = F.col(error).cast("double")
    return errors.groupBy(key).agg(F.avg(e).alias("mean_error"), F.percentile(e, 0.95).alias("p95_error"), F.max(e).alias("max_error"), F.avg(F.when(e >= threshold, 1.0).otherwise(0.0)).alias("highlighted_ratio"))


def region_contrast(errors: DataFrame, key: str, error: str, inside: Column) -> DataFrame:
    e = F.col(error).cast("double")
    means = errors.groupBy(key).agg(F.avg(F.when(inside, e)).alias("region_mean"), F.avg(F.when(~inside, e)).alias("background_mean"))
    return means.withColumn("region_ratio", F.when(F.col("background_mean") > 0, F.col("region_mean") / F.col("background_mean")))
