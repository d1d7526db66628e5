"""Detectors of personal data that reject whole records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column

#: Detectors by name. (?U) makes word characters and digits Unicode ones.
PATTERNS = {
    "email": r"(?iU)(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "cn_mobile": r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)",
    "cn_id": r"(?U)(?<!\d)\d{17}[0-9Xx](?!\d)",
    "bank_card": r"(?U)(?<!\d)\d{16,19}(?!\d)",
    "private_key": r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----",
    "api_token": r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{16,}",
    "cn_address": r"(?:北京市|上海市|天津市|重庆市|[一-鿿]{2,8}省)[一-鿿]{2,12}(?:市|区|县).{0,30}(?:路|街|道|巷|号)",
}
#: The reduced set for cases, which stands between word borders.
CASE_PATTERNS = {"cn_mobile": r"(?U)\b1[3-9]\d{9}\b", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "cn_id": r"(?U)\b\d{17}[0-9Xx]\b"}
#: Masked addresses that sources use as placeholders.
PLACEHOLDERS = ("XXX@YYY.com", "xxx@yyy.com")


def types(c: Column | str, names: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """Sorted names of the detectors that match, placeholders aside. Null text has none."""
    text = F.coalesce(column(c), F.lit(""))
    for p in PLACEHOLDERS:
        text = F.replace(text, F.lit(p), F.lit(""))
    return F.array_compact(F.array(*[F.when(text.rlike(PATTERNS[n]), F.lit(n)) for n in sorted(names)]))


def in_case(c: Column | str) -> Column:
    """Does a detector of the reduced set match? Null text has nothing."""
    return F.greatest(*[F.coalesce(column(c), F.lit("")).rlike(p) for p in CASE_PATTERNS.values()])
