import hashlib
import hmac

from pyspark.sql import functions as F

from kinmerge.functions import normalize as N
from kinmerge.functions.similarity import jaro_winkler_of


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_contacts(spark):
    assert values(spark, lambda c: N.email_key(N.email(c)), "<A.B+x@GoogleMail.com>", "mailto:a+b@Example.com", "n/a", None, "x@y") == ["ab@gmail.com", "a@example.com", None, None, None]
    assert values(spark, N.phone, "(727) 555-0100 ext 5", "1-727-555-0100", "0044 20 7946 0958", "+1", "055-555-0100") == ["+17275550100", "+17275550100", "+442079460958", None, None]


def test_names(spark):
    got = values(spark, N.split_full_name, "Dr. Robert J. Smith Jr.", "SMITH, bob", "José", "")
    assert [(r["first"], r["last"], r["suffix"]) for r in got] == [("Robert", "Smith", "jr"), ("Bob", "Smith", None), ("José", None, None), (None, None, None)]
    assert values(spark, N.first_name_key, "Bob", "José Luis", "Élodie") == ["robert", "jose", "elodie"]


def test_accents_of_any_script_and_any_white_space(spark):
    assert values(spark, N.name_key, "Nguyễn", "Ａnna", "Ọkafọr", "ﬁnn", "Ḥaddād", "王", None) == ["nguyen", "anna", "okafor", "finn", "haddad", None, None]
    assert values(spark, N.strip_accents, "Ⅷ Ã", "plain", None) == ["VIII A", "plain", None]
    assert values(spark, N.clean, "\u00a0unknown\u2003", "Smith\u00a0", "a \u3000 b", "\x1cN/A\x1c", " x ") == [None, "Smith", "a b", None, "x"]
    long = "Mc" + "x" * 3000
    assert values(spark, N.name_part, long.upper(), "SMITH o'neil", "Smith, (Jr)!") == ["Mc" + "x" * 3000, "Smith O'neil", "Smith Jr"]


def test_numbers_abroad(spark):
    assert values(spark, lambda c: N.phone(c, "44"), "020 7946 0958", "0044 20 7946 0958", "12345", "x") == ["+442079460958", "+442079460958", None, None]


def test_years_beyond_the_jobs(spark):
    assert values(spark, lambda c: N.date(c, 2027), "2027-01-01", "2028-01-01") == ["2027-01-01", None]
    assert values(spark, lambda c: N.date(c, 2026), "March 2, 1980", "2/30/1980", "1980/3/2", "3-2-1980") == ["1980-03-02", None, "1980-03-02", "1980-03-02"]


def test_dates_and_the_rest(spark):
    assert values(spark, lambda c: N.date(c, 2026), "3/2/1980", "1980-03-02T10:00:00", "Mar 2 1980", "02.03.1980", "19800302", "1880-01-01", "x") == ["1980-03-02"] * 5 + [None, None]
    assert values(spark, lambda c: N.timestamp(c, 2026), "0000000060", "2024-05-01T12:00:00.000+0000", "3/2/1980") == ["1970-01-01T00:01:00Z", "2024-05-01T12:00:00Z", "1980-03-02T00:00:00Z"]
    assert values(spark, N.postal, "33701-1234", "3370", "SW1A 1AA") == ["33701", "03370", None]
    assert values(spark, N.address_key, "12 North Main Street, Apartment 4") == ["12 n main st apt 4"]
    assert values(spark, N.boolean, "Opted_In", "0", "maybe") == [True, False, None]
    assert values(spark, N.country, "usa", "UK", "fr") == ["US", "GB", "FR"]


def test_keyed_hash_is_hmac(spark):
    assert values(spark, lambda c: N.keyed_hash(c, "email", b"k"), "a@b.com") == [hmac.new(b"k", b"email:a@b.com", hashlib.sha256).hexdigest()]


def test_jaro_winkler():
    assert jaro_winkler_of("martha", "marhta") == 0.9611111111111111
    assert jaro_winkler_of("a", "b") == 0 and jaro_winkler_of("", "a") == 0 and jaro_winkler_of("ab", "ab") == 1
