"""Value expressions: fixed vectors, and random text against the Python model."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.functions import (
    clean_numeric,
    is_valid_email,
    normalize_cpf,
    normalize_score,
    parse_timestamp,
    strip_text,
    validate_cpf,
)
from covenant.functions.text import WHITE_SPACE
from covenant.operators.typing import conform
from tests import value_model as model
from tests.helpers import column, make

SCORES = {"LOW": 0.1, "Medium": 0.5, "HIGH": 0.9, "over": 7.0, "12": 0.3}


def apply(spark, values, build, kind=T.StringType()):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)])
    df = spark.createDataFrame(list(enumerate(values)), schema)
    return [r[1] for r in df.select("i", build(F.col("v"))).orderBy("i").collect()]


AMOUNTS = {
    "7": 7.0, "0042": 42.0, "-18.75": -18.75, "\u20ac 12,5": 12.5, "CHF 3.407,08": 3407.08, "88,1": 88.1,
    "9.876.543,2": 9876543.2, "ninety": None, "  ": None, None: None, "\t- 7 ": -7.0, "5.": 5.0, "x12y": 12.0,
    "1.2,3.4": 12.34, "2,000.75": 2.00075, "4.4.4": None, "4,4,4": None, "9-1": None, "--5": None, "-": None,
    ".": None, ",": None, "nan": None, "inf": None, "true": None, "1\u00a0250,50": 1250.5, "-2E+2": -200.0,
    "6e-1": 0.6, " 3.5E3 ": 3500.0, "+1e5": 100000.0, "\u00a0-4e0\n": -4.0, "1 e5": 15.0, "+8": 8.0, "e5": 5.0,
}


def test_clean_numeric_vectors(spark):
    assert apply(spark, AMOUNTS, clean_numeric) == list(AMOUNTS.values())


def test_clean_numeric_from_other_types(spark):
    assert apply(spark, [-12.5, 0.0, None], lambda c: clean_numeric(c, T.DoubleType()), T.DoubleType()) == [-12.5, 0.0, None]
    assert apply(spark, [7], lambda c: clean_numeric(c, T.LongType()), T.LongType()) == [7.0]
    assert apply(spark, [True, False], lambda c: clean_numeric(c, T.BooleanType()), T.BooleanType()) == [None, None]


def _document(body: str) -> str:
    """Nine digits and the two check digits that the model accepts."""
    return next(body + f"{c:02d}" for c in range(100) if model.id_is_valid(body + f"{c:02d}"))


def test_normalize_cpf_vectors(spark):
    values = {"902 837-465/01": "90283746501", "x90283746501y": "90283746501", "9028374650": None, None: None, "4" * 12: None}
    assert apply(spark, values, normalize_cpf) == list(values.values())


def test_validate_cpf_vectors(spark):
    good = [_document(body) for body in ("902837465", "000000191", "718281828")]
    values = {text: True for text in good} | {f"{t[:3]}.{t[3:6]}.{t[6:9]}-{t[9:]}": True for t in good}
    values |= {t[:10] + str((int(t[10]) + 3) % 10): False for t in good}
    values |= {"7" * 11: False, good[0][:10]: False, good[0] + "0": False, "-": False, None: False}
    assert apply(spark, values, validate_cpf) == list(values.values())


def test_email_vectors(spark):
    values = {
        "k+tag@sub.host.io": True, "1@2.3": True, "one@host": False, " ": False, None: False, "host.io": False,
        "\tk@h.io\u2003": True, "k @h.io": False, "k\u00a0x@h.io": False, "k@h.io\n": True, "k@@h.io": False,
        "k@.": False, "k\x1fx@h.io": False, "k@h.": False, "@h.io": False,
    }
    assert apply(spark, values, is_valid_email) == list(values.values())


def test_score_vectors(spark):
    values = {
        "high": 0.9, " Low\t": 0.1, "mediuM": 0.5, "0.37": 0.37, "42": 1.0, "-0.5": 0.0, "-0": 0.0, "n/a": None,
        None: None, " ": None, "3e-1": 0.3, "NaN": 1.0, "-nan": 1.0, "+nan": 1.0, "INF": 1.0, "-Infinity": 0.0,
        "1d": None, "0x1p3": None, "1_0": None, "over": 1.0, "12": 1.0, ".25": 0.25, "0.": 0.0,
    }
    found = apply(spark, values, lambda c: normalize_score(c, SCORES))
    assert found == list(values.values())


def test_score_from_other_types(spark):
    got = apply(spark, [0.0, 0.625, 1.0001, math.inf, -7.25, None, math.nan], lambda c: normalize_score(c, {}, T.DoubleType()), T.DoubleType())
    assert got == [0.0, 0.625, 1.0, 1.0, 0.0, None, 1.0]
    assert apply(spark, [True], lambda c: normalize_score(c, {}, T.BooleanType()), T.BooleanType()) == [None]
    assert apply(spark, ["x"], lambda c: normalize_score(c, {})) == [None]


def test_parse_timestamp_takes_the_first_format_that_fits(spark):
    formats = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy[ HH:mm]"]
    values = {
        "2024-01-15T10:30:00Z": "2024-01-15 10:30:00", "2024-01-15T10:30:00-03": "2024-01-15 13:30:00",
        "2024-01-15 15:10:00": "2024-01-15 15:10:00", "31/12/1999": "1999-12-31 00:00:00",
        "31/12/1999 07:08": "1999-12-31 07:08:00", "2024-13-15 15:10:00": None, "soon": None, None: None,
        "2024-01-15t10:30:00Z": "2024-01-15 10:30:00",
    }
    found = apply(spark, values, lambda c: parse_timestamp(c, formats).cast("string"))
    assert found == list(values.values())
    with pytest.raises(ValueError, match="at least one format"):
        parse_timestamp(F.lit("x"), [])


def test_times_that_are_typed_already_need_no_format(spark):
    df = spark.sql("SELECT DATE'2023-11-05' AS d, TIMESTAMP'2023-11-05 06:07:08' AS t, TIMESTAMP_NTZ'2023-11-05 06:07:08' AS n, CAST(NULL AS DATE) AS z")
    stamp = {"transform": "parse_timestamp", "formats": ["dd/MM/yyyy HH:mm"]}
    typed = conform(df, make(*(column(c, "timestamp", **stamp) for c in "dtnz")))
    assert [str(v) for v in typed.first()] == ["2023-11-05 00:00:00", "2023-11-05 06:07:08", "2023-11-05 06:07:08", "None"]


def test_white_space_is_what_python_strips(spark):
    every = [f"{chr(i)}x{chr(i)}" for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    assert apply(spark, every, strip_text) == [text.strip() for text in every]
    assert len(WHITE_SPACE) == 29


def _random_texts(alphabet: str, longest: int, seed: int, n: int = 3000) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(n)]


def same(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-15))


def test_clean_numeric_against_the_model(spark):
    texts = _random_texts("0123459.,-+eE $Rx\u00a0\u20ac", 9, 1)
    found = apply(spark, texts, clean_numeric)
    assert [(t, f, model.amount(t)) for t, f in zip(texts, found) if not same(f, model.amount(t))] == []


def test_score_against_the_model(spark):
    texts = _random_texts("0129.+-eE nainf\u00a0", 6, 2) + ["low", "HIGH ", "Over", " 12"]
    found = apply(spark, texts, lambda c: normalize_score(c, SCORES))
    assert [(t, f) for t, f in zip(texts, found) if not same(f, model.score(t, SCORES))] == []


def test_email_against_the_model(spark):
    texts = _random_texts("ab@@..- \u00a0\n", 8, 3)
    found = apply(spark, texts, is_valid_email)
    assert [t for t, f in zip(texts, found) if f != model.email_is_valid(t)] == []


def test_documents_against_the_model(spark):
    rng = random.Random(4)
    texts = _random_texts("0123456789.-", 14, 5)
    for _ in range(2000):  # random bodies with every pair of check digits now and then right
        body = "".join(rng.choices("0123456789", k=9))
        texts += [body + f"{c:02d}" for c in rng.sample(range(100), 3)]
        right = next(f"{c:02d}" for c in range(100) if model.id_is_valid(body + f"{c:02d}"))
        texts.append(body + right)
    assert apply(spark, texts, validate_cpf) == [model.id_is_valid(t) for t in texts]
    assert apply(spark, texts, normalize_cpf) == [model.bare_id(t) for t in texts]
