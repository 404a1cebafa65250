"""Identity keys of postings, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# URL shapes of applicant systems in order of preference, the key's prefix, and its parts
# (number of the match's group, how it is written).
ATS_PATTERNS = (
    (r"greenhouse\.io/(?:embed/job_app\?for=)?([a-z0-9_.-]+)/jobs/(\d+)", "gh", ((1, "lower"), (2, "same"))),
    (r"greenhouse\.io/embed/job_app\?for=([a-z0-9_.-]+).*?[?&]token=(\d+)", "gh", ((1, "lower"), (2, "same"))),
    (r"lever\.co/([a-z0-9_.-]+)/([0-9a-f-]{36})", "lv", ((1, "lower"), (2, "lower"))),
    (r"ashbyhq\.com/([a-z0-9_.-]+)/([0-9a-f-]{36})", "ab", ((1, "lower"), (2, "lower"))),
    (r"//(?:www\.)?([a-z0-9][a-z0-9-]*)\.wd\d+\.myworkdayjobs\.com/.*?_((?:JR|R|REQ)[-_]?\d[\w-]*)", "wd", ((1, "lower"), (2, "squash"))),
    (r"myworkdayjobs\.com/wday/cxs/([a-z0-9-]+)/.*?_((?:JR|R|REQ)[-_]?\d[\w-]*)", "wd", ((1, "lower"), (2, "squash"))),
    (r"myworkdaysite\.com/(?:[a-z]{2}-[A-Z]{2}/)?recruiting/([a-z0-9_-]+)/.*?_((?:JR|R|REQ)[-_]?\d[\w-]*)", "wd", ((1, "lower"), (2, "squash"))),
    (r"//([a-z0-9.-]*?myworkday(?:jobs|site)\.com)/.*?_((?:JR|R|REQ)[-_]?\d[\w-]*)", "wd", ((1, "host"), (2, "squash"))),
    (r"google\.com/about/careers/applications/jobs/results/(\d+)|careers\.google\.com/jobs/results/(\d+)", "goog", ((0, "either"),)),
    (r"jobs\.apple\.com/[a-z-]+/details/(\d+)", "appl", ((1, "same"),)),
    (r"metacareers\.com/jobs/(\d+)", "meta", ((1, "same"),)),
    (r"smartrecruiters\.com/([^/?#]+)/(\d+)", "sr", ((1, "lower"), (2, "same"))),
    (r"[?&]gh_jid=(\d+)", "gh:jid", ((1, "same"),)),
    (r"([a-z0-9-]+)\.applytojob\.com/apply/([A-Za-z0-9]+)", "atj", ((1, "lower"), (2, "same"))),
    (r"ats\.rippling\.com/(?:[a-z-]+/)?([a-z0-9_.-]+)/jobs/([0-9a-f-]{36})", "rip", ((1, "lower"), (2, "lower"))),
    (r"amazon\.jobs/(?:[a-z-]+/)?jobs/(\d+)", "amzn", ((1, "same"),)),
    (r"lifeattiktok\.com/(?:search|position)/(\d+)", "tt", ((1, "same"),)),
    (r"jobs\.jobvite\.com/([^/]+)/job/([a-zA-Z0-9]+)", "jv", ((1, "lower"), (2, "same"))),
    (r"//([a-z0-9][a-z0-9-]*)\.icims\.com/jobs/(\d+)", "icims", ((1, "lower"), (2, "same"))),
    (r"workable\.com/([^/?#]+)/j(?:obs)?/([A-Z0-9]{6,})", "wk", ((1, "lower"), (2, "upper"))),
    (r"linkedin\.com/jobs/view/(?:[^/]*-)?(\d{6,})", "li", ((1, "same"),)),
)

# Fixed values of the frozen older scheme, in full: stored keys were written with these shapes.
LEGACY_PATTERNS = (
    (r"greenhouse\.io/(?:embed/job_app\?for=)?([a-z0-9_.-]+)/jobs/(\d+)", "gh", ((1, "lower"), (2, "same"))),
    (r"greenhouse\.io/embed/job_app\?for=([a-z0-9_.-]+).*?[?&]token=(\d+)", "gh", ((1, "lower"), (2, "same"))),
    (r"lever\.co/([a-z0-9_.-]+)/([0-9a-f-]{36})", "lv", ((1, "lower"), (2, "lower"))),
    (r"ashbyhq\.com/([a-z0-9_.-]+)/([0-9a-f-]{36})", "ab", ((1, "lower"), (2, "lower"))),
    (r"myworkdayjobs\.com/.*?_((?:JR|R|REQ)[-_]?\d[\w-]*)", "wd", ((1, "squash"),)),
    (r"google\.com/about/careers/applications/jobs/results/(\d+)|careers\.google\.com/jobs/results/(\d+)", "goog", ((0, "either"),)),
    (r"jobs\.apple\.com/[a-z-]+/details/(\d+)", "appl", ((1, "same"),)),
    (r"metacareers\.com/jobs/(\d+)", "meta", ((1, "same"),)),
    (r"smartrecruiters\.com/[^/]+/(\d+)", "sr", ((1, "same"),)),
    (r"[?&]gh_jid=(\d+)", "gh:jid", ((1, "same"),)),
    (r"([a-z0-9-]+)\.applytojob\.com/apply/([A-Za-z0-9]+)", "atj", ((1, "lower"), (2, "same"))),
    (r"ats\.rippling\.com/(?:[a-z-]+/)?([a-z0-9_.-]+)/jobs/([0-9a-f-]{36})", "rip", ((1, "lower"), (2, "lower"))),
    (r"amazon\.jobs/(?:[a-z-]+/)?jobs/(\d+)", "amzn", ((1, "same"),)),
    (r"lifeattiktok\.com/(?:search|position)/(\d+)", "tt", ((1, "same"),)),
    (r"jobs\.jobvite\.com/[^/]+/job/([a-zA-Z0-9]+)", "jv", ((1, "same"),)),
    (r"icims\.com/jobs/(\d+)", "icims", ((1, "same"),)),
    (r"workable\.com/[^/]*j(?:obs)?/([A-Z0-9]{8,})", "wk", ((1, "upper"),)),
    (r"linkedin\.com/jobs/view/(?:[^/]*-)?(\d{6,})", "li", ((1, "same"),)),
)

# What a URL of each shape holds, in lower case, by the shape's prefix; a shape is looked for only where it stands.
SIGNS = {
    "gh": "greenhouse.io/", "lv": "lever.co/", "ab": "ashbyhq.com/", "wd": "myworkday", "goog": "google.com/", "appl": "jobs.apple.com/", "meta": "metacareers.com/jobs/",
    "sr": "smartrecruiters.com/", "gh:jid": "gh_jid=", "atj": ".applytojob.com/apply/", "rip": "ats.rippling.com/", "amzn": "amazon.jobs/", "tt": "lifeattiktok.com/",
    "jv": "jobs.jobvite.com/", "icims": "icims.com/jobs/", "wk": "workable.com/", "li": "linkedin.com/jobs/view/",
}

# Query parameters without identity, and words without meaning in names and places.
TRACKING = (
    r"(?i)^(utm_\w+|gh_src|gh_jid|src|source|ref|referrer|trk|trackingId|embed|lever-source|ashby_jid|"
    r"jobPipeline|iis|iisn|mobile|needsRedirect|hl|lang|locale|nl|fr|from|_ga|fbclid|gclid)$"
)
COMPANY_WORDS = ("inc", "llc", "ltd", "corp", "corporation", "co", "company", "technologies", "technology", "labs", "group", "holdings", "plc", "gmbh", "sa", "ag", "nv", "the")
# those of titles also as single words, for titles without "new", before which a word may go with the next one
SINGLE_TITLE_WORDS = (
    "summer", "fall", "winter", "spring", "intern", "internship", "coop", "bs", "ms", "phd", "bachelor", "bachelors", "master", "masters",
    "undergrad", "undergraduate", "grad", "graduate",
)
TITLE_WORDS = r"\b(20\d\d|summer|fall|winter|spring|intern|internship|co-?op|bs|ms|phd|bachelors?|masters?|undergrad(uate)?|grad(uate)?|new\s*grad)\b"
PLACE_WORDS = ("united", "states", "usa", "us", "u.s.", "u.s.a.", "america", "remote", "hybrid", "onsite", "on-site", "in")
LEGACY_PLACE_WORDS = ("united states", "usa", "us", "remote in", "hybrid")
SEASONS = (("summer", "su"), ("fall", "fa"), ("autumn", "fa"), ("winter", "wi"), ("spring", "sp"))
INTERN = r"(?i)\b(intern|interns|internship|internships|co-?ops?|co\s+ops?)\b"
NEW_GRAD = (
    r"(?i)\b(new\s*grad(uate)?|graduate\s+(program|role|position|scheme)|\d{4}\s+grads?|associate|entry[\s-]?level|"
    r"full[\s-]?time|staff|principal|senior|sr\.?|lead|trainee|volunteer|apprentice(ship)?)\b"
)

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squash(c: Column) -> Column:
    """Lower case without hyphens and underscores."""
    return F.translate(F.lower(c), "-_", "")


def _written(url: Column, pattern: str, group: int, how: str) -> Column:
    if how == "either":
        return F.concat(F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2))
    part = F.regexp_extract(url, pattern, group)
    ways = {"lower": F.lower, "upper": F.upper, "same": lambda x: x, "squash": squash, "host": lambda x: F.regexp_replace(F.lower(x), r"^www\.", "")}
    return ways[how](part)


def _held(c: Column, of: Callable[[Column], Column]) -> Column:
    """of(c), for which c is computed once, however often it is used."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def _first_shape(url: Column, low: Column, shapes) -> Column:
    """The key of the first shape that the URL (and in lower case) has; few URLs hold the sign of more than one, so few
    patterns are tried."""
    found = []
    for pattern, prefix, parts in shapes:
        there = low.contains(SIGNS[prefix])
        found.append(F.when(there, _held(F.regexp_extract(url, "(?i)" + pattern, 0), lambda m: F.when(m != "", F.concat_ws(":", F.lit(prefix), *(_written(m, "(?i)" + pattern, g, how) for g, how in parts))))))
    return F.coalesce(*found, F.lit(""))


def ats_key(url: Column | str) -> Column:
    """The requisition's key by the first applicant system whose URL shape is found, or ''."""
    return _first_shape(_text(url), F.lower(_text(url)), ATS_PATTERNS)


def employer_key(url: Column | str) -> Column:
    """ats_key(), but '' for an aggregator's."""
    key = ats_key(url)
    return F.when(key.startswith("li:"), "").otherwise(key)


def query_signature(query: Column) -> Column:
    """The parameters that carry identity, decoded, sorted and encoded again; '' if there are none."""

    def plain(c: Column) -> Column:
        return F.when(c.contains("%") | c.contains("+"), F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))).otherwise(c)

    def coded(c: Column) -> Column:
        written = F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
        return F.when(c.rlike(r"^[a-zA-Z0-9._~-]*\z"), c).otherwise(written)

    pairs = F.transform(F.split(_text(query), "&"), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.sort_array(F.filter(pairs, lambda p: (p["v"] != "") & ~p["k"].rlike(TRACKING)))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    return F.when(_text(query) == "", "").otherwise(_held(joined, lambda j: F.when(j == "", "").otherwise(F.concat(F.lit("?"), j))))


def _address(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 2)), r"^www\.", "")
    return F.concat(F.lit("url:"), host, F.lower(F.regexp_replace(F.regexp_extract(url, _URL, 3), "/+$", "")))


def url_key(url: Column | str) -> Column:
    """ats_key(), else host, path and identity-bearing query; '' for an empty URL."""
    return _url_key(_text(url), ats_key(url))


def _url_key(u: Column, shape: Column) -> Column:
    return F.when(u == "", "").when(shape != "", shape).otherwise(F.concat(_address(u), query_signature(F.regexp_extract(u, _URL, 4))))


def legacy_url_key(url: Column | str) -> Column:
    """The key an older scheme gave: fewer tenants, and no query."""
    u = _text(url)
    return F.when(u == "", "").otherwise(F.coalesce(F.nullif(_first_shape(u, F.lower(u), LEGACY_PATTERNS), F.lit("")), _address(u)))


def uuid_key(uuid: Column | str) -> Column:
    return F.when(_text(uuid) == "", "").otherwise(F.concat(F.lit("sj:"), _text(uuid)))


def _collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm(c: Column | str) -> Column:
    """Lower case, with a space for each run of anything but letters and digits, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", " "))


def _words(c: Column | str, left_out: Callable[[Column], Column]) -> Column:
    """norm() without the words that are left out."""
    return F.array_join(F.filter(F.split(F.lower(_text(c)), "[^a-z0-9]+"), lambda t: (t != "") & ~left_out(t)), " ")


def normalize_company(c: Column | str) -> Column:
    return _words(c, lambda t: t.isin(*COMPANY_WORDS))


def normalize_title(c: Column | str) -> Column:
    single = _words(c, lambda t: t.isin(*SINGLE_TITLE_WORDS) | ((F.length(t) == 4) & t.startswith("20") & t.rlike(r"^\d+$")))
    return F.when(F.lower(_text(c)).contains("new"), _collapsed(F.regexp_replace(norm(c), TITLE_WORDS, " "))).otherwise(single)


def normalize_location(c: Column | str) -> Column:
    return _words(c, lambda t: t.isin(*PLACE_WORDS))


def season_token(*texts: Column | str) -> Column:
    """Season and year of the first text that names a season."""
    found = []
    for text in map(_text, texts):
        word = reduce(lambda rest, s: F.when(F.lower(text).contains(s[0]), s[1]).otherwise(rest), reversed(SEASONS), F.lit(None).cast("string"))
        found.append(F.concat(word, F.regexp_extract(text, r"\b(20\d\d)\b", 1)))
    return F.coalesce(*found, F.lit(""))


def level_token(title: Column | str) -> Column:
    t = _text(title)
    return F.when(t.rlike(INTERN), "intern").when(t.rlike(NEW_GRAD), "newgrad").otherwise("")


def _prefix(company: Column, title: Column) -> Column:
    return F.concat(F.lit("id:"), company, F.lit("|"), title, F.lit("|"))


def _identity(company: Column, title: Column, location: Column, level: Column, season: Column) -> Column:
    return F.when((company == "") | (title == ""), "").otherwise(F.concat(_prefix(company, title), F.concat_ws("|", location, level, season)))


def id_prefix(company: Column | str, title: Column | str) -> Column:
    return _prefix(normalize_company(company), normalize_title(title))


def identity_key(company: Column | str, title: Column | str, location: Column | str, season: Column | str) -> Column:
    """Company, title, place, level and season; '' if company or title has nothing left."""
    return _identity(normalize_company(company), normalize_title(title), normalize_location(location), level_token(title), season_token(season, title))


def _distinct(*keys: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k != ""))


def with_keys(df: DataFrame) -> DataFrame:
    """Adds url_key, employer_key, identity_key, id_prefix and keys, strongest first. Null fields count as empty.

    What several keys share is computed once, in a step before.
    """
    steps = {"_company": normalize_company("company"), "_title": normalize_title("title"), "_place": normalize_location("location"), "_level": level_token("title"), "_season": season_token("season", "title")}
    df = df.withColumns({"_url": _text("apply_url"), "_low": F.lower(_text("apply_url")), **steps})
    df = df.withColumn("_shape", _first_shape(F.col("_url"), F.col("_low"), ATS_PATTERNS))
    df = df.withColumn("url_key", _url_key(F.col("_url"), F.col("_shape"))).drop("_url", "_low", "_shape")
    df = df.withColumns(
        {
            "employer_key": F.when(F.col("url_key").startswith("li:") | F.col("url_key").startswith("url:"), "").otherwise(F.col("url_key")),
            "identity_key": _identity(*(F.col(c) for c in steps)),
            "id_prefix": _prefix(F.col("_company"), F.col("_title")),
        }
    ).drop(*steps)
    return df.withColumn("keys", _distinct(uuid_key("posting_uuid"), F.col("url_key"), F.col("identity_key")))


def with_legacy_keys(df: DataFrame) -> DataFrame:
    """Adds legacy_keys, as the older scheme wrote them."""
    place = norm("location")
    for word in LEGACY_PLACE_WORDS:
        place = F.replace(place, F.lit(word), F.lit(" "))
    blank = (normalize_company("company") == "") | (normalize_title("title") == "")
    identity = F.when(blank, "").otherwise(F.concat(id_prefix("company", "title"), _collapsed(place)))
    return df.withColumn("legacy_keys", _distinct(uuid_key("posting_uuid"), legacy_url_key("apply_url"), identity))
