"""Scalar normalizers as native column expressions; null means rejected or absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These decide results and must stay as they are.
NULL_WORDS = ("null", "none", "n/a", "na", "-", "unknown")
EMAIL_PATTERN = r"^[A-Za-z0-9._%+'\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
GMAIL_DOMAINS = ("gmail.com", "googlemail.com")
NICKNAMES = {
    "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert",
    "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william",
    "jim": "james", "jimmy": "james", "jamie": "james",
    "mike": "michael", "mikey": "michael", "mick": "michael",
    "dave": "david", "davey": "david",
    "dick": "richard", "rick": "richard", "ricky": "richard", "rich": "richard", "richie": "richard",
    "tom": "thomas", "tommy": "thomas",
    "joe": "joseph", "joey": "joseph",
    "chris": "christopher", "kit": "christopher",
    "dan": "daniel", "danny": "daniel",
    "matt": "matthew",
    "tony": "anthony",
    "steve": "steven", "stephen": "steven",
    "jon": "jonathan", "johnny": "john", "jack": "john",
    "ed": "edward", "eddie": "edward", "ted": "edward", "ned": "edward",
    "andy": "andrew", "drew": "andrew",
    "alex": "alexander", "sasha": "alexander",
    "ben": "benjamin", "benny": "benjamin",
    "sam": "samuel", "sammy": "samuel",
    "nick": "nicholas", "nicky": "nicholas",
    "greg": "gregory", "pat": "patrick", "patty": "patricia", "trish": "patricia",
    "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth",
    "kate": "katherine", "katie": "katherine", "kathy": "katherine", "cathy": "katherine", "catherine": "katherine",
    "jen": "jennifer", "jenny": "jennifer",
    "sue": "susan", "susie": "susan",
    "meg": "margaret", "maggie": "margaret", "peggy": "margaret",
    "debbie": "deborah", "deb": "deborah",
    "becky": "rebecca", "becca": "rebecca",
    "vicky": "victoria", "tori": "victoria",
    "abby": "abigail", "mandy": "amanda", "manny": "manuel",
    "jess": "jessica", "jessie": "jessica",
    "chuck": "charles", "charlie": "charles",
    "larry": "lawrence", "hank": "henry", "harry": "henry",
}
SUFFIXES = {
    "jr": "jr", "jr.": "jr", "junior": "jr", "sr": "sr", "sr.": "sr", "senior": "sr",
    "ii": "ii", "iii": "iii", "iv": "iv", "2nd": "ii", "3rd": "iii",
}
TITLES = ("mr", "mrs", "ms", "dr", "prof", "miss")
STREET_WORDS = {
    "street": "st", "avenue": "ave", "road": "rd", "drive": "dr", "boulevard": "blvd",
    "lane": "ln", "court": "ct", "place": "pl", "apartment": "apt", "suite": "ste",
    "north": "n", "south": "s", "east": "e", "west": "w",
}
COUNTRIES = {"USA": "US", "UNITED STATES": "US", "UNITED STATES OF AMERICA": "US", "U.S.": "US", "UK": "GB", "UNITED KINGDOM": "GB", "CANADA": "CA"}
TRUE_WORDS = ("true", "t", "yes", "y", "1", "subscribed", "opted_in", "opt-in", "granted")
FALSE_WORDS = ("false", "f", "no", "n", "0", "unsubscribed", "opted_out", "opt-out", "denied", "not_subscribed")
DATE_FORMATS = ("yyyy-M-d", "MMM d yyyy", "MMMM d, yyyy")
#: The other accepted ways to write a date, in figures, and the same as year-month-day.
DATE_SHAPES = (
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$1-$2"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
)


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def _or_null(c: Column) -> Column:
    """Null for an empty string; the expression is used once."""
    return F.nullif(c, F.lit(""))


def _matching(c: Column, pattern: str) -> Column:
    """The value if all of it matches, else null; the expression is used once."""
    return _or_null(F.regexp_extract(c, pattern, 0))


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks, by the Unicode library Spark ships; plain ASCII skips it."""
    decomposed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(decomposed, r"\p{Mn}+", "")).otherwise(c)


def clean(c: Column) -> Column:
    """Trimmed, white space of any kind as single spaces; null for words that mean none."""
    s = F.btrim(F.regexp_replace(c.cast("string"), r"(?U)[\s\x1c-\x1f]+", " "))
    return _or_null(F.regexp_replace(s, "(?i)^(?:" + "|".join(NULL_WORDS) + ")$", ""))


def email(c: Column) -> Column:
    return _matching(F.replace(F.btrim(F.lower(clean(c)), F.lit("<>")), F.lit("mailto:"), F.lit("")), EMAIL_PATTERN)


def email_key(c: Column) -> Column:
    """Of a normalized address: no +tag anywhere; for Gmail no dots either."""
    local, domain = F.split_part(F.substring_index(c, "@", 1), F.lit("+"), F.lit(1)), F.substring_index(c, "@", -1)
    gmail = domain.isin(*GMAIL_DOMAINS)
    return F.when(gmail, F.concat(F.replace(local, F.lit("."), F.lit("")), F.lit("@gmail.com"))).otherwise(F.concat(local, F.lit("@"), domain))


def phone(c: Column, default_cc: str = "1") -> Column:
    """+ and digits. Each step rewrites what it applies to and leaves the rest."""
    s = F.regexp_replace(clean(c), r"(?i)\s*(?:x|ext\.?|extension)\s*\d+$", "")
    s = F.regexp_replace(F.regexp_replace(s, "^00", "+"), r"(?!^\+)\D", "")
    s = F.regexp_replace(s, r"^\+(?!\d{8,15}$).*", "")
    if default_cc == "1":
        s = F.regexp_replace(F.regexp_replace(s, r"^([2-9]\d{9})$", "+1$1"), r"^(1\d{10})$", "+$1")
    else:
        s = F.regexp_replace(s, r"^(?=\d{6,13}$)0*(\d*)$", f"+{default_cc}$1")
    return _matching(s, r"^\+\d+$")


def name_part(c: Column) -> Column:
    s = F.regexp_replace(clean(c), r"(?U)[^\w\s'\-.]", "")
    word = lambda w: F.when((w == F.upper(w)) | (w == F.lower(w)), F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))).otherwise(w)
    return F.array_join(F.transform(F.filter(F.split(s, r"\s+"), lambda w: w != ""), word), " ")


def name_key(c: Column) -> Column:
    return _or_null(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z]", ""))


def first_name_key(c: Column) -> Column:
    return canonical_first(name_key(F.split_part(F.ltrim(c), F.lit(" "), F.lit(1))))


def canonical_first(key: Column) -> Column:
    """The formal name that a nickname's key stands for, else the key itself."""
    return F.coalesce(_mapped(key, NICKNAMES), key)


def suffix(c: Column) -> Column:
    return _mapped(F.lower(clean(c)), SUFFIXES)


def split_full_name(c: Column) -> Column:
    """struct(first, last, suffix) of 'Last, First Sfx' or 'Title First … Last Sfx'."""
    s = clean(c)
    comma = s.contains(",")
    rest = F.when(comma, F.regexp_replace(s, r"^[^,]*,", "")).otherwise(s)
    parts = F.filter(F.split(rest, r"\s+"), lambda w: w != "")
    parts = F.when(comma, parts).otherwise(F.filter(parts, lambda w: ~F.rtrim(F.lower(w), F.lit(".")).isin(*TITLES)))
    last_word = F.lower(F.try_element_at(parts, F.lit(-1)))
    sfx = _mapped(last_word, SUFFIXES)
    parts = F.when(sfx.isNotNull(), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    first = name_part(F.try_element_at(parts, F.lit(1)))
    last = F.when(comma, name_part(F.split_part(s, F.lit(","), F.lit(1)))).when(F.size(parts) > 1, name_part(F.try_element_at(parts, F.lit(-1))))
    return F.struct(first.alias("first"), last.alias("last"), sfx.alias("suffix"))


def date(c: Column, this_year: int) -> Column:
    """yyyy-MM-dd of the first format that fits with a year from 1900 to ``this_year``, which a job states."""
    s = F.split_part(clean(c), F.lit("T"), F.lit(1))
    for pattern, iso in DATE_SHAPES:
        s = F.regexp_replace(s, pattern, iso)
    # a format is tried only where those before it do not fit: one that does not costs an exception
    fit = lambda f: F.get(F.filter(F.array(F.try_to_timestamp(s, F.lit(f)).cast("date")), lambda d: F.year(d).between(1900, this_year)), F.lit(0))
    return F.date_format(F.coalesce(*(fit(f) for f in DATE_FORMATS)), "yyyy-MM-dd")


def timestamp(c: Column, this_year: int, allow_unix: bool = True) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ in UTC (the session's zone must be UTC)."""
    out = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    s = clean(c)
    iso = F.when(s.rlike(r"^\d{4}-\d\d-\d\d"), F.date_format(F.try_to_timestamp(s), out))
    other = F.coalesce(iso, F.concat(date(s, this_year), F.lit("T00:00:00Z")))
    if not allow_unix:
        return other
    seconds = F.try_to_number(s, F.lit("99999999999")).cast("bigint")
    return F.when(s.rlike(r"^\d{9,11}$"), F.when(seconds <= 4_102_444_800, F.date_format(F.timestamp_seconds(seconds), out))).otherwise(other)


def postal(c: Column, country_code: Column | None = None) -> Column:
    s = F.upper(clean(c))
    own = F.regexp_replace(F.regexp_replace(s, r"^(\d{5})-?\d{4}$", "$1"), r"^(\d{4})$", "0$1")
    own = _matching(own, r"^\d{5}$")
    return own if country_code is None else F.when(F.coalesce(country_code, F.lit("US")).isin("US", "USA"), own).otherwise(s)


def address_key(c: Column) -> Column:
    s = F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9 ]", " ")
    words = F.filter(F.split(s, " +"), lambda w: w != "")
    return _or_null(F.array_join(F.transform(words, lambda w: F.coalesce(_mapped(w, STREET_WORDS), w)), " "))


def country(c: Column) -> Column:
    s = F.upper(clean(c))
    return F.coalesce(_mapped(s, COUNTRIES), s)


def boolean(c: Column) -> Column:
    s = F.lower(clean(c))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def mask(c: Column) -> Column:
    """The shape of a value: first 64 characters, letters to a or A, digits to 9."""
    return F.mask(F.substring(c, 1, 64), F.lit("A"), F.lit("a"), F.lit("9"))


def keyed_hash(c: Column, kind: str, key: bytes) -> Column:
    """HMAC-SHA256 of 'kind:value', composed of two hashes over the padded key."""
    padded = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in padded) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.unhex(F.lit(inner.hex())), F.concat(F.lit(kind + ":"), c).cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), F.unhex(first)), 256)
