"""The registered queries as SQL for DuckDB, over the same tables.

Column names, parameters and rounding follow the registry. Queries without an entry hold something
SQL does not express: a principal component, a hash, a checkpointed row number.
"""

from __future__ import annotations

from reviewlens.functions.wordlists import FILM_STOPWORDS
from reviewlens.plans import bridges
from reviewlens.plans.registry import (
    ACCENTED,
    CUT,
    END,
    KEYWORDS,
    REGION,
    SHARE,
    START,
    STOPWORDS,
    WORD_FILE,
)

# Spark's English stopwords.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

# The library's word pattern in the dialect of DuckDB, with its quotes doubled.
_LETTERS, _DIGITS = r"[\p{L}\p{M}\p{Nl}]+", r"\p{Nd}+"
_RUN = f"{_LETTERS}(?:[''‘’.·]{_LETTERS})*|{_DIGITS}(?:[''‘’.,;]{_DIGITS})*"
_TOKEN = f"_*(?:{_RUN})(?:{_RUN}|_)*|__+"
_VIEWS = {
    "reviews": bridges.REVIEWS,
    "ratings": bridges.RATINGS,
    "vectors": bridges.VECTORS,
    "source_a": bridges.SOURCE_A,
    "source_b": bridges.SOURCE_B,
    "both_texts": """
        SELECT id::VARCHAR AS id, content AS text FROM source_a
        UNION ALL SELECT id::VARCHAR, comment FROM source_b""",
    "points": """
        SELECT v.*, v.embedding[1]::DOUBLE AS dim1, v.embedding[2]::DOUBLE AS dim2
        FROM vectors v SEMI JOIN reviews r USING (id)""",
    "tokens": f"""
        SELECT id, rating, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS word
        FROM reviews""",
    "frequency": """
        SELECT word, count(*) AS n FROM tokens
        WHERE length(word) >= 2 AND regexp_matches(word, '[a-z]') GROUP BY word""",
}
_NEEDS = {"both_texts": ("source_a", "source_b"), "points": ("reviews", "vectors"), "tokens": ("reviews",), "frequency": ("tokens",)}


def _with(views: str, body: str) -> str:
    """The query with the named bridge views, and those they need, in front."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in views.split():
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({_VIEWS[name]})" for name in wanted) + body


def _r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0::DOUBLE AS {name}"


def _list(words: list[str]) -> str:
    return ", ".join("'" + word.replace("'", "''") + "'" for word in words)


_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160))"
_LEVEL = "CASE WHEN rating IN (1,2,3,4,5,6,7,8,9,10) THEN rating::INT END"
_TRUNCATED = "CASE WHEN trunc(rating) BETWEEN 1 AND 10 THEN trunc(rating)::INT END"


def _distribution(level: str) -> str:
    return _with(
        "ratings",
        f"""
        , counts AS (SELECT platform, {level} AS rating, count(*) AS n FROM ratings
                     WHERE rating IS NOT NULL GROUP BY ALL)
        SELECT platform, rating, n,
               {_r("n / sum(n) OVER (PARTITION BY platform)", "prop")} FROM counts""",
    )


def _summary(source: str, groups: str, shares: dict[str, str], guard: str = "true") -> str:
    def stat(expression: str, name: str) -> str:
        return _r(f"CASE WHEN {guard} THEN {expression} END", name)

    columns = [
        stat("avg(rating)", "mean"),
        stat("stddev_samp(rating)", "sd"),
        stat("quantile_cont(rating, 0.5)", "median"),
        stat("quantile_cont(rating, 0.25)", "p25"),
        stat("quantile_cont(rating, 0.75)", "p75"),
        *[stat(f"avg((rating {test})::INT)", name) for name, test in shares.items()],
    ]
    return f"\nSELECT {groups}, count(*) AS n, {', '.join(columns)} FROM {source} GROUP BY {groups}"


_PAGE_SHARES = {"prop_10": "= 10", "prop_7_10": ">= 7", "prop_1_3": "<= 3"}


def _trend(view: str, unit: str, min_n: int, with_sd: bool = False) -> str:
    spread = _r("stddev_samp(rating)", "sd_rating") + "," if with_sd else ""
    return _with(
        view,
        f"""
        SELECT platform, date_trunc('{unit}', date)::DATE AS period,
               {_r("avg(rating)", "mean_rating")}, {spread} count(*) AS n
        FROM {view} GROUP BY ALL HAVING count(*) >= {min_n}""",
    )


_QUARTERS = """
    quarters AS (SELECT platform, date_trunc('quarter', date)::DATE AS period_q, count(*) AS n
                 FROM reviews GROUP BY ALL)"""


def _dense(min_n: int) -> str:
    return f"""{_QUARTERS},
    dense AS (SELECT period_q FROM quarters GROUP BY period_q HAVING min(n) >= {min_n})"""


def _density(source: str, groups: str, extend: bool = False) -> str:
    """Kernel density of ``source`` by the columns in ``groups``."""
    low, high = ("lo - 3 * h", "hi + 3 * h") if extend else ("1", "10")
    return f"""
    , kept AS (SELECT {groups}, rating FROM {source} WHERE rating BETWEEN 1 AND 10),
    stats AS (SELECT {groups}, count(*) AS total, min(rating) AS lo, max(rating) AS hi,
                     stddev_samp(rating) AS sd,
                     (quantile_cont(rating, 0.75) - quantile_cont(rating, 0.25)) / 1.34::DOUBLE AS q
              FROM kept GROUP BY {groups} HAVING count(*) > 1),
    widths AS (SELECT *, 0.9::DOUBLE * power(total, -0.2::DOUBLE)
                      * CASE WHEN least(sd, q) > 0 THEN least(sd, q) WHEN sd > 0 THEN sd
                             WHEN lo <> 0 THEN abs(lo) ELSE 1 END AS h FROM stats),
    counts AS (SELECT {groups}, rating, count(*) AS n FROM kept GROUP BY {groups}, rating),
    grid AS (SELECT *, i::INT AS point, ({low}) + i * (({high}) - ({low})) / 511::DOUBLE AS x
             FROM widths, range(512) AS g(i))
    SELECT {groups}, point, {_r("max(x)", "x")}, {_r("max(h)", "bandwidth")},
           {_r("sum(n * exp(-0.5::DOUBLE * power((x - rating) / h, 2)) "
               "/ (total * h * sqrt(2 * pi())))", "density")}
    FROM grid JOIN counts USING ({groups}) GROUP BY {groups}, point"""


def _split(view: str, share: float, where: str = "true") -> str:
    return f"""
    , kept AS (SELECT * FROM {view} WHERE {where}),
    cutoff AS (SELECT quantile_disc(date, {share}) AS cutoff_date FROM kept),
    split AS (SELECT kept.*, cutoff_date,
                     CASE WHEN date <= cutoff_date THEN 'early'
                          WHEN date > cutoff_date THEN 'late' END AS period_group
              FROM kept, cutoff)"""


def _cutoff(source: str, where: str = "true") -> str:
    return f"""
    split AS (SELECT *, DATE '{CUT}' AS cutoff_date,
                     CASE WHEN date < DATE '{CUT}' THEN 'early'
                          WHEN date >= DATE '{CUT}' THEN 'late' END AS period_group
              FROM {source} WHERE {where})"""


_SPLIT_COLUMNS = "\nSELECT id, platform, date, cutoff_date, period_group FROM split"


def _words(where: str, min_chars: int, also: str) -> str:
    return _with(
        "tokens",
        f"""
        SELECT word, count(*) AS n FROM tokens
        WHERE {where} AND length(word) >= {min_chars} AND {also} GROUP BY word""",
    )


_LATIN = "regexp_matches(word, '[a-z]')"
_FREQUENT = """
    , counts AS (SELECT word, count(*) AS n FROM tokens WHERE length(word) >= 2 GROUP BY word),
    stop AS (SELECT word FROM (SELECT word, rank() OVER (ORDER BY n DESC) AS k FROM counts)
             WHERE k <= 60),
    words AS (SELECT id, stops, regexp_extract_all(lower(text), '{}') AS all_words
              FROM reviews, (SELECT list(word) AS stops FROM stop)),
    kept AS (SELECT id, array_to_string(list_filter(all_words,
                 lambda w: NOT list_contains(stops, w)), ' ') AS text_nostop
             FROM words)
    SELECT id, text_nostop FROM kept""".format(_TOKEN)


def _mentions(keyword: str) -> str:
    return f"list_contains(regexp_extract_all(lower(text), '{_TOKEN}'), '{keyword}')"


def _lemmas(stopwords: list[str]) -> str:
    # \p{L} with the letter- and other-numbers: what the stand-in analyser tags as a noun.
    return f"""array_to_string(list_filter(
        regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'),
        lambda w: NOT list_contains([{_list(stopwords)}], w)), ' ')"""


_LINES = """
    WITH lines AS (
        SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10)))))::INT AS place FROM documents),
    clean AS (SELECT *, array_to_string(regexp_extract_all(line, '[^\\s\\p{Z}]+'), ' ') AS body
              FROM lines)"""

_UNIT = """
    unit AS (SELECT * EXCLUDE (embedding),
                    list_transform(embedding, lambda x: x::DOUBLE / len2) AS embedding
             FROM (SELECT *, sqrt(list_sum(list_transform(embedding,
                       lambda x: x::DOUBLE * x::DOUBLE))) AS len2 FROM {}))"""


def _similar(source: str, selected: str, k: int) -> str:
    """Rows of ``source`` closest to the centroid of the selected ones."""
    return f"""
    , {_UNIT.format(source)},
    flat AS (SELECT *, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS pos
             FROM unit),
    mean AS (SELECT pos, avg(value) AS m FROM flat WHERE {selected} GROUP BY pos),
    scaled AS (SELECT pos, m / sqrt(sum(m * m) OVER ()) AS c FROM mean),
    sims AS (SELECT id, sum(value * c) AS sim FROM flat JOIN scaled USING (pos) GROUP BY id),
    closest AS (SELECT id, sim FROM sims ORDER BY sim DESC, id LIMIT {k})"""


def _leading(name: str, matrix: str, squarings: int = 14) -> str:
    """CTEs up to ``name``: the leading eigenvector of a symmetric matrix, by repeated squaring.

    The column of the largest diagonal element of a high power is the vector; its largest
    component is made positive.
    """
    steps = []
    before = matrix
    for k in range(squarings):
        steps.append(f"""
    {name}_{k} AS MATERIALIZED (
        SELECT i, j, v / max(abs(v)) OVER () AS v FROM (
            SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {before} a JOIN {before} b ON a.j = b.i
            GROUP BY a.i, b.j))""")
        before = f"{name}_{k}"
    steps.append(f"""
    {name} AS MATERIALIZED (
        SELECT i, v * sign(arg_max(v, abs(v)) OVER ()) / sqrt(sum(v * v) OVER ()) AS v
        FROM {before} WHERE j = (SELECT i FROM {before} WHERE i = j ORDER BY v DESC, i LIMIT 1))""")
    return ",".join(steps)


def _components(source: str) -> str:
    """The first two principal components of the vectors, the second after deflation."""
    return f"""
    , flat AS MATERIALIZED (
        SELECT id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM {source}),
    centred AS MATERIALIZED (SELECT id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM flat),
    cov AS MATERIALIZED (
        SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM centred a JOIN centred b USING (id)
        GROUP BY a.i, b.i), {_leading("first_pc", "cov")},
    level AS (SELECT sum(a.v * cov.v * b.v) AS strength FROM first_pc a JOIN cov ON a.i = cov.i
              JOIN first_pc b ON b.i = cov.j),
    deflated AS MATERIALIZED (
        SELECT cov.i, cov.j, cov.v - strength * a.v * b.v AS v FROM cov JOIN first_pc a ON a.i = cov.i
        JOIN first_pc b ON b.i = cov.j CROSS JOIN level), {_leading("second_pc", "deflated")}
    SELECT id, {_r("sum(x * f.v)", "dim1", 4)}, {_r("sum(x * s.v)", "dim2", 4)}
    FROM centred c JOIN first_pc f ON f.i = c.i JOIN second_pc s ON s.i = c.i GROUP BY id"""


_X0, _X1, _Y0, _Y1 = REGION
_IN_REGION = (
    f"dim1 BETWEEN {_X0}::DOUBLE AND {_X1}::DOUBLE "
    f"AND dim2 BETWEEN {_Y0}::DOUBLE AND {_Y1}::DOUBLE"
)

ORACLES: dict[str, str] = {
    "harmonise_union": _with("reviews", "\nSELECT * FROM reviews"),
    "filter_date_platform": _with(
        "reviews",
        f"""
        SELECT id, platform, date, rating FROM reviews
        WHERE date BETWEEN DATE '{START}' AND DATE '{END}' AND platform = 'alpha'
          AND rating IS NOT NULL""",
    ),
    "filter_platforms_rating": _with(
        "ratings",
        f"""
        SELECT id, platform, date, rating FROM ratings
        WHERE date <= DATE '{END}' AND platform IN ('alpha') AND rating BETWEEN 3 AND 8""",
    ),
    "date_bounds": _with(
        "ratings",
        """
        SELECT min(date) AS date_min, max(date) AS date_max,
               datediff('day', min(date), max(date))::INT AS span_days FROM ratings""",
    ),
    "trend_axis": _with(
        "reviews",
        """
        , trend AS (SELECT platform, date_trunc('month', date)::DATE AS period FROM reviews
                    GROUP BY ALL HAVING count(*) >= 3),
        bounds AS (SELECT min(period) AS date_min, max(period) AS date_max,
                          datediff('day', min(period), max(period))::INT AS span_days FROM trend)
        SELECT *, CASE WHEN span_days / 30.4 <= 6 THEN '1 month'
                       WHEN span_days / 30.4 <= 18 THEN '3 months'
                       WHEN span_days / 30.4 <= 36 THEN '6 months'
                       WHEN span_days IS NOT NULL THEN '1 year' END AS axis_break FROM bounds""",
    ),
    "rating_distribution": _distribution(_LEVEL),
    "rating_distribution_truncated": _distribution(_TRUNCATED),
    "rating_summary_skip": _with("ratings", _summary("ratings", "platform", _PAGE_SHARES)),
    "rating_summary_propagate": _with(
        "ratings",
        ", kept AS (SELECT *, id::BIGINT % 19 AS part FROM ratings)"
        + _summary("kept", "platform, part", _PAGE_SHARES, "count(*) = count(rating)"),
    ),
    "rating_trend_day": _trend("ratings", "day", 3),
    "rating_trend_week": _trend("ratings", "week", 5),
    "rating_trend_month": _trend("ratings", "month", 1, with_sd=True),
    "quarter_counts": _with(
        "ratings",
        """
        SELECT platform, date_trunc('quarter', date)::DATE AS period_q, count(*) AS n
        FROM ratings GROUP BY ALL""",
    ),
    "dense_periods": _with("reviews", f", {_dense(20)} SELECT period_q FROM dense"),
    "dense_periods_all_platforms": _with(
        "reviews",
        f""", {_QUARTERS}
        SELECT period_q FROM quarters GROUP BY period_q HAVING min(n) >= 5
           AND count(*) = (SELECT count(DISTINCT platform) FROM quarters)""",
    ),
    "dense_reviews": _with(
        "reviews",
        f""", {_dense(20)}
        SELECT id, platform, date, rating, date_trunc('quarter', date)::DATE AS period_q
        FROM reviews WHERE date_trunc('quarter', date)::DATE IN (SELECT period_q FROM dense)""",
    ),
    "rating_histogram": _with(
        "ratings",
        """
        , bins AS (SELECT platform, greatest(ceil(rating), 1) AS bin FROM ratings
                   WHERE rating BETWEEN 0.5 AND 10.5)
        SELECT platform, bin - 1.0::DOUBLE AS bin_low, bin + 0.0::DOUBLE AS bin_high,
               count(*) AS n FROM bins GROUP BY ALL""",
    ),
    "rating_boxstats": _with(
        "ratings",
        f"""
        , kept AS (SELECT * FROM ratings WHERE rating BETWEEN 1 AND 10),
        hinges AS (SELECT platform, count(*) AS n, quantile_cont(rating, 0.25) AS q1,
                          quantile_cont(rating, 0.5) AS q2, quantile_cont(rating, 0.75) AS q3
                   FROM kept GROUP BY platform),
        marked AS (SELECT *, rating BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
                   FROM kept JOIN hinges USING (platform))
        SELECT platform, max(n) AS n,
               {_r("least(min(rating) FILTER (inside), max(q1))", "whisker_low")},
               {_r("max(q1)", "hinge_low")}, {_r("max(q2)", "median")},
               {_r("max(q3)", "hinge_high")},
               {_r("greatest(max(rating) FILTER (inside), max(q3))", "whisker_high")},
               count(*) FILTER (NOT inside) AS n_outliers
        FROM marked GROUP BY platform""",
    ),
    "rating_density": _with("ratings", _density("ratings", "platform")),
    "rating_density_extended": _with("reviews", _density("reviews", "platform", extend=True)),
    "early_late_split": _with(
        "reviews", _split("reviews", SHARE, f"date >= DATE '{START}'") + _SPLIT_COLUMNS
    ),
    "early_late_cutoff": _with(
        "reviews", ", " + _cutoff("reviews", f"date <= DATE '{END}'") + _SPLIT_COLUMNS
    ),
    "early_late_summary": _with(
        "ratings",
        _split("ratings", SHARE)
        + _summary("split", "platform, period_group", {"prop_10": "= 10", "prop_9_10": ">= 9"}),
    ),
    "early_late_density": _with(
        "ratings",
        _split("ratings", 0.5).replace("kept", "all_kept")
        + _density("split", "platform, period_group"),
    ),
    "early_late_density_cutoff": _with(
        "reviews",
        f""", {_dense(10)},
        dense_reviews AS (SELECT * FROM reviews
            WHERE date_trunc('quarter', date)::DATE IN (SELECT period_q FROM dense)),
        {_cutoff("dense_reviews")} {_density("split", "platform, period_group")}""",
    ),
    "early_late_normalised": _with(
        "ratings",
        f"""
        , counts AS (
            SELECT platform, CASE WHEN date_trunc('quarter', date)::DATE < DATE '1997-04-01'
                                  THEN 'early' ELSE 'late' END AS phase,
                   {_TRUNCATED} AS rating, count(*) AS n
            FROM ratings WHERE rating IS NOT NULL GROUP BY ALL),
        shares AS (SELECT *, n / sum(n) OVER (PARTITION BY platform, phase) AS p FROM counts)
        SELECT platform, phase, rating, n, {_r("p", "prop_phase")},
               {_r("p / sum(p) OVER (PARTITION BY platform, rating)", "prop_norm")}
        FROM shares""",
    ),
    "tokenize": _with("tokens", "\nSELECT id, word FROM tokens"),
    "word_frequency": _with("frequency", "\nSELECT word, n FROM frequency"),
    "word_frequency_high": _words("rating >= 8", 2, _LATIN),
    "word_frequency_stored": _words("rating >= 8", 2, _LATIN),
    "word_frequency_script": _words(
        f"regexp_matches(word, '{ACCENTED}')", 2, "word NOT IN ('été', 'même', 'más')"
    ),
    "word_frequency_low": _words("rating <= 3", 3, _LATIN),
    "word_frequency_stopped": _words("true", 2, f"word NOT IN ({_list(STOPWORDS)})"),
    "top_words": _with(
        "frequency",
        """
        SELECT word, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS k FROM frequency)
        WHERE k <= 2000""",
    ),
    "top_keywords": _with(
        "frequency",
        """
        SELECT word, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS k FROM frequency
                             WHERE length(word) >= 3 AND n >= 5) WHERE k <= 100""",
    ),
    "cloud_words": _words("rating >= 3", 2, _LATIN)
    + " HAVING count(*) >= 3 ORDER BY n DESC, word LIMIT 150",
    "merge_stopwords": f"""
        WITH tables AS (
            SELECT unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS word,
                   'talk' AS lexicon, 0 AS place FROM conversations
            UNION ALL
            SELECT unnest(regexp_extract_all(lower(text), '{_TOKEN}')), 'items', 1 FROM benchmark
            UNION ALL
            SELECT unnest([{_list(FILM_STOPWORDS)}]), NULL, 2)
        SELECT word, lexicon FROM (
            SELECT *, row_number() OVER (PARTITION BY word ORDER BY place) AS k FROM tables)
        WHERE k = 1""",
    "remove_stopwords": _with("tokens", _FREQUENT + " WHERE text_nostop <> ''"),
    "remove_stopwords_join": _with("tokens", _FREQUENT),
    "stopword_pipeline": _with(
        "reviews",
        f"""
        , stop AS (SELECT [{_list([*ENGLISH_STOPWORDS, *FILM_STOPWORDS])},
                           {_list([w.strip() for w in WORD_FILE if w.strip()])}] AS stops),
        words AS (SELECT id, stops, regexp_extract_all(lower(text), '{_TOKEN}') AS w FROM reviews, stop),
        kept AS (SELECT id, array_to_string(list_filter(w,
                     lambda x: NOT list_contains(stops, x)), ' ') AS text_nostop FROM words)
        SELECT id, text_nostop FROM kept WHERE text_nostop <> ''""",
    ),
    "keyword_rating_counts": _with(
        "reviews",
        f"""
        , counts AS (SELECT rating, count(DISTINCT id) AS n FROM reviews
                     WHERE {_mentions("der")} GROUP BY rating)
        SELECT {_r("rating", "rating")}, n, {_r("n / sum(n) OVER ()", "prop")} FROM counts""",
    ),
    "keyword_rating_distribution": _with(
        "reviews",
        f"""
        , hits AS (SELECT DISTINCT id, platform, rating::INT AS rating FROM reviews
                   WHERE rating IS NOT NULL AND (
                       {" OR ".join(f"(platform = '{p}' AND {_mentions(k)})"
                                    for p, k in KEYWORDS.items())})),
        grid AS (SELECT platform_order::INT AS platform_order, platform, rating::INT AS rating
                 FROM (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(KEYWORDS, 1))})
                      AS p(platform_order, platform), range(1, 11) AS g(rating)),
        counts AS (SELECT platform_order, grid.platform, grid.rating, count(id) AS n
                   FROM grid LEFT JOIN hits USING (platform, rating) GROUP BY ALL)
        SELECT platform_order, platform, rating, n,
               {_r("CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0 END", "prop")}
        FROM counts WINDOW w AS (PARTITION BY platform)""",
    ),
    "normalize_reviews": _with(
        "reviews",
        f"""
        SELECT id, text AS original_text, {_lemmas(STOPWORDS)} AS normalized_text FROM reviews""",
    ),
    "normalize_reviews_analyser": _with(
        "reviews",
        f"""
        , words AS (SELECT id, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+') AS w
                    FROM reviews),
        lemmas AS (SELECT id, list_transform(w, lambda x:
                       CASE WHEN length(x) > 5 THEN x[1 : length(x) - 1] ELSE x END) AS w FROM words)
        SELECT id, array_to_string(list_filter(w,
                   lambda x: NOT list_contains([{_list(STOPWORDS)}], x)), ' ') AS normalized_text
        FROM lemmas""",
    ),
    "write_normalized": _with(
        "reviews",
        f"""
        SELECT id, nullif(text, '') AS original_text,
               nullif({_lemmas(STOPWORDS)}, '') AS normalized_text FROM reviews""",
    ),
    "merge_normalized": _with(
        "reviews",
        f"""
        SELECT id, platform, rating,
               CASE WHEN platform = 'beta' THEN {_lemmas([])} END AS normalized_text
        FROM reviews""",
    ),
    "select_text_column": _with("both_texts", "\nSELECT id, text FROM both_texts"),
    "load_texts": f"""
        SELECT id, text FROM (
            SELECT doc_id::VARCHAR AS id, {_STRIP.format("unnest(string_split(text, '.'))")} AS text
            FROM documents) WHERE text <> ''""",
    "extract_article_reviews": _LINES
    + """
        SELECT page_id, CASE WHEN place % 3 = 0 THEN 'by é' ELSE 'ann' END || place AS author,
               CASE WHEN place % 3 = 0 THEN 'Sum ' || (place % 10 + 1) ELSE 'Line ' || place END
                   AS title,
               place::VARCHAR AS rating, body AS text
        FROM clean WHERE body <> ''""",
    "extract_card_reviews": _LINES
    + """
        SELECT page_id, 'w' || place AS writer_id, (place % 10 + 1)::VARCHAR AS star,
               CASE WHEN place % 3 = 0 THEN 'told "' || place || '"' ELSE body END AS text,
               '20200105' AS date, place::VARCHAR AS up,
               CASE WHEN place % 3 = 0 THEN (place % 10 + 1)::VARCHAR ELSE '' END AS down
        FROM clean""",
    "extract_page_title": r"""
        WITH pieces AS (
            SELECT page_id, regexp_replace(html,
                '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'gis') AS page
            FROM pages),
        raw AS (
            SELECT page_id, regexp_extract(page, '<title\b[^>]*>(.*?)</title\s*>', 1, 'is') AS t
            FROM pieces)
        SELECT page_id, trim(string_split(trim(regexp_replace(
            replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'),
                '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)),
                '&amp;', '&'),
            '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')), '-')[1]) AS title FROM raw""",
    "extract_page_title_branches": """
        SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Café ’s ' || page_id
                                         WHEN 1 THEN chr(39) || page_id || '&lt;'
                                         ELSE 'Plain ' || page_id || ' ©' END AS title FROM pages
        UNION ALL SELECT page_id, 'K가 ' || page_id FROM pages""",
    "title_key": r"""
        SELECT page_id, replace(regexp_replace(url, '[\\/*?:"<>|]', '', 'g'), ' ', '_')
               || '_reviews.csv' AS title_key FROM pages""",
    "standardise_crawl": _with(
        "source_a source_b",
        """
        SELECT md5('4:beta' || length('w' || (id % 97)) || ':w' || (id % 97)
                   || '8:' || strftime(writing_date, '%Y%m%d')
                   || length(comment) || ':' || comment) AS id,
               'beta' AS platform, writing_date AS date,
               CASE WHEN id % 11 <> 0 THEN star_rating::DOUBLE END AS rating, comment AS text,
               upvote::INT AS upvote, CASE WHEN downvote > 0 THEN downvote::INT END AS downvote,
               'w' || (id % 97) AS author, NULL AS title FROM source_b
        UNION ALL
        SELECT md5('5:alpha' || length('u' || (id % 89)) || ':u' || (id % 89) || '-'
                   || length(content) || ':' || content),
               'alpha', NULL, star_rating::DOUBLE, content, NULL, NULL,
               'u' || (id % 89), 'Title ' || id FROM source_a""",
    ),
    "csv_round_trip": _with(
        "reviews", "\nSELECT * REPLACE ('  ' || text || ' ' AS text) FROM reviews"
    ),
    "csv_scan_lines": _with(
        "both_texts",
        """
        SELECT id, nullif(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '') AS text
        FROM both_texts""",
    ),
    "l2_normalize": _with(
        "vectors",
        f""", {_UNIT.format("vectors")}
        SELECT id, (generate_subscripts(embedding, 1) - 1)::INT AS pos,
               {_r("unnest(embedding)", "value", 4)} FROM unit""",
    ),
    "load_embeddings": _with(
        "reviews vectors",
        f""", {_UNIT.format("vectors")}
        SELECT reviews.id, reviews.platform, date, reviews.rating,
               {_r("embedding[1]", "first", 4)}
        FROM reviews JOIN unit USING (id)""",
    ),
    "load_embeddings_first_match": _with(
        "reviews vectors",
        f""", {_UNIT.format("vectors")}
        SELECT reviews.id, {_r("embedding[1]", "first", 4)}
        FROM reviews JOIN unit ON unit.id::BIGINT = 2 * reviews.id::BIGINT""",
    ),
    "load_embeddings_repeated": _with(
        "reviews vectors",
        f""", both_signs AS (
            SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM vectors
            UNION ALL SELECT id, list_transform(embedding, lambda x: -x::DOUBLE) FROM vectors),
        least_one AS (SELECT id, min(e) AS embedding FROM both_signs GROUP BY id),
        {_UNIT.format("least_one")}
        SELECT reviews.id, {_r("embedding[1]", "first", 4)} FROM reviews JOIN unit USING (id)""",
    ),
    "union_embeddings": _with(
        "vectors", f"\nSELECT id, {_r('embedding[1]::DOUBLE', 'first', 4)} FROM vectors"
    ),
    "centroid": _with(
        "vectors",
        _similar("vectors", "rating <= 3", 1).replace(_UNIT.format("vectors"),
                                                      "unit AS (SELECT * FROM vectors)")
        + f" SELECT (pos - 1)::INT AS pos, {_r('c', 'value', 4)} FROM scaled",
    ),
    "closest_to_centroid": _with(
        "vectors",
        _similar("vectors", "rating = 7", 25)
        + f"""
        SELECT id, platform, {_r("rating", "rating", 4)}, {_r("sim", "sim", 4)}
        FROM closest JOIN vectors USING (id)""",
    ),
    "representatives": _with(
        "points",
        _similar("points", _IN_REGION, 10)
        + """
        SELECT id, r.platform, r.rating, round_even(sim, 3) AS sim,
               CASE WHEN length(text) > 120 THEN substring(text, 1, 117) || '...' ELSE text END
                   AS snippet
        FROM closest LEFT JOIN (SELECT * FROM reviews WHERE id::BIGINT % 3 <> 0) r USING (id)""",
    ),
    "knn_graph": _with(
        "vectors",
        f""", {_UNIT.format("vectors")},
        pairs AS (SELECT a.id, b.id AS neighbour,
                         list_dot_product(a.embedding, b.embedding) AS sim
                  FROM unit a JOIN unit b ON a.id <> b.id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS k
                   FROM pairs)
        SELECT id, k::INT AS rank, neighbour, {_r("sim", "sim", 4)} FROM ranked WHERE k <= 5""",
    ),
    "text_length_summary": _with(
        "reviews",
        """
        , sized AS (SELECT platform, length(text)::DOUBLE AS chars FROM reviews)
        SELECT platform, count(*) AS n, min(chars) AS min,
               round(quantile_cont(chars, 0.25), 6) AS q1, round(median(chars), 6) AS median,
               round(avg(chars), 6) AS mean, round(quantile_cont(chars, 0.75), 6) AS q3,
               max(chars) AS max, count(*) - count(chars) AS n_missing
        FROM sized GROUP BY platform""",
    ),
    "text_length_quantiles": _with(
        "reviews",
        """
        , sized AS (SELECT platform, rating, length(text)::DOUBLE AS chars FROM reviews
                    WHERE text IS NOT NULL)
        SELECT platform, rating, probability::DOUBLE AS probability, count(*) AS n,
               round(CASE probability WHEN 0 THEN min(chars) WHEN 0.1 THEN quantile_cont(chars, 0.1)
                     WHEN 0.5 THEN quantile_cont(chars, 0.5) ELSE quantile_cont(chars, 0.999) END, 6)
                 AS quantile
        FROM sized, (SELECT unnest([0.0, 0.1, 0.5, 0.999]) AS probability)
        GROUP BY platform, rating, probability""",
    ),
    "select_region": _with(
        "points",
        f"""
        SELECT id, platform, {_r("rating", "rating", 4)}, {_r("dim1", "dim1", 4)},
               {_r("dim2", "dim2", 4)} FROM points WHERE {_IN_REGION}""",
    ),
    "region_summary": _with(
        "points",
        f"""
        SELECT count(*) AS n, {_r("min(rating)", "rating_min")},
               {_r("quantile_cont(rating, 0.25)", "rating_q1")},
               {_r("quantile_cont(rating, 0.5)", "rating_median")},
               {_r("avg(rating)", "rating_mean")},
               {_r("quantile_cont(rating, 0.75)", "rating_q3")},
               {_r("max(rating)", "rating_max")}, count(*) - count(rating) AS n_missing
        FROM points WHERE {_IN_REGION}""",
    ),
    "platform_mix": _with(
        "points",
        f"""
        SELECT platform, count(*) AS n FROM points WHERE {_IN_REGION} GROUP BY platform""",
    ),
    "attach_projection": _with(
        "vectors",
        f"""
        SELECT id, platform, {_r("rating", "rating", 4)},
               {_r("embedding[1]::DOUBLE", "dim1", 4)}, {_r("embedding[2]::DOUBLE", "dim2", 4)},
               row_number() OVER (ORDER BY platform, id) AS idx FROM vectors""",
    ),
    "embed_texts": _with(
        "reviews",
        f"""
        SELECT id, {", ".join(
            f"(length(text) - length(replace(text, '{v}', '')))::DOUBLE AS n_{v}" for v in "aeiou"
        )} FROM reviews WHERE {_STRIP.format("text")} <> ''""",
    ),
    "quantize_f16": _with(
        "vectors",
        """
        , flat AS (SELECT id, (generate_subscripts(embedding, 1) - 1)::INT AS pos,
                          unnest(embedding)::DOUBLE AS x FROM vectors),
        steps AS (SELECT *, power(2::DOUBLE,
                      greatest(floor(log2(greatest(abs(x), 1e-30))), -14) - 10) AS step FROM flat)
        SELECT id, pos, round_even(x / step, 0) * step AS value FROM steps""",
    ),
    "write_embeddings": _with(
        "vectors",
        f"""
        SELECT id, (generate_subscripts(embedding, 1) - 1)::INT AS pos,
               {_r("unnest(embedding)::DOUBLE", "col", 4)} FROM vectors""",
    ),
    "normalize_stream": _with(
        "both_texts",
        f"""
        SELECT id, text AS original_text, {_lemmas(STOPWORDS)} AS normalized_text FROM both_texts""",
    ),
    "embed_texts_hashed": _with(
        "reviews",
        f"""
        , kept AS (SELECT id, text FROM reviews WHERE {_STRIP.format("text")} <> ''),
        words AS (SELECT id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS word FROM kept),
        counts AS (SELECT id, (('0x' || substr(md5(word), 1, 8))::UBIGINT % 64)::INT AS pos,
                          count(*)::DOUBLE AS n FROM words GROUP BY ALL),
        scaled AS (SELECT id, pos, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS value FROM counts)
        SELECT id, g.pos::INT AS pos, {_r("coalesce(value, 0)", "col", 4)}
        FROM kept CROSS JOIN range(64) AS g(pos) LEFT JOIN scaled USING (id, pos)""",
    ),
    "project_pca": _with("vectors", f", {_UNIT.format('vectors')} {_components('unit')}"),
    "cached_projection": _with("vectors", _components("vectors")),
}

# Date columns of the results, compared as ISO text.
_DATES = {
    "harmonise_union": "date",
    "filter_date_platform": "date",
    "filter_platforms_rating": "date",
    "date_bounds": "date_min date_max",
    "trend_axis": "date_min date_max",
    "rating_trend_day": "period",
    "rating_trend_week": "period",
    "rating_trend_month": "period",
    "quarter_counts": "period_q",
    "dense_periods": "period_q",
    "dense_periods_all_platforms": "period_q",
    "dense_reviews": "date period_q",
    "early_late_split": "date cutoff_date",
    "early_late_cutoff": "date cutoff_date",
    "standardise_crawl": "date",
    "csv_round_trip": "date",
    "load_embeddings": "date",
}
for _name, _columns in _DATES.items():
    _texts = ", ".join(f"CAST({column} AS VARCHAR) AS {column}" for column in _columns.split())
    ORACLES[_name] = f"SELECT * REPLACE ({_texts}) FROM ({ORACLES[_name]})"

# The same rows by way of a stored index.
for _name in ("keyword_rating_counts", "keyword_rating_distribution"):
    ORACLES[f"{_name}_indexed"] = ORACLES[_name]
for _name in ("select_region", "region_summary", "platform_mix"):
    ORACLES[f"{_name}_stored"] = ORACLES[_name]
# And by way of a stream.
ORACLES["running_trend_month"] = ORACLES["rating_trend_month"]
ORACLES["running_quarter_counts"] = ORACLES["quarter_counts"]
ORACLES["load_embeddings_bucketed"] = ORACLES["load_embeddings"]
ORACLES["closest_to_centroid_cells"] = ORACLES["closest_to_centroid"]
ORACLES["representatives_cells"] = ORACLES["representatives"].replace(" WHERE id::BIGINT % 3 <> 0", "")
