"""SQL counterparts of the registered queries, over the given tables.

Each statement is assembled from the views it needs. They state the semantics in plain relational
form: per-word lists, exploded terms, built-in quantiles and full cross comparisons.
"""

from __future__ import annotations

import re

# Output names and patterns that the library states as well.
WHITE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = r"[\p{L}\p{N}_]{2,}"
MARKUP = "<.*?>|&([a-z0-9]+|#[0-9]{1,6}|#x[0-9a-f]{1,6});"
CODE = "(?s)<code>.*?</code>"
ISO = "%Y-%m-%dT%H:%M:%S.%g"
BASE = 1000000000000
ASKED = (
    "printf('%04d-%02d-%02dT08:30:00.000', 2012 + d.doc_id % 10, 1 + d.doc_id % 12, 1 + d.doc_id % 28)"
)
METRICS = (
    "Flesch_Kincard_Grade",
    "Flesch_reading_ease",
    "Coleman_Liau_index",
    "code_percentage",
    "cos_sim_post_title",
    "cos_sim_title_tag",
    "sentiment",
)
FEATURES = ("FG", "FE", "CL", "CP", "CSPT", "CSTT", "SENT")
COUNTERS = ("_Score", "_ViewCount", "_AnswerCount", "_CommentCount", "_FavoriteCount")
DELAYS = ("AnswerDurationSeconds", "AnswerDurationMinute", "AnswerDurationHour", "AnswerDurationDays")
SLOW = (
    "code_percentage",
    "cos_sim_post_title",
    "cos_sim_title_tag",
    "AnswerDurationMinute",
    "_Score",
    "_ViewCount",
    "Flesch_reading_ease",
    "sentiment",
)
AMPLIFIERS = "('absolutely','completely','especially','extremely','highly','really','so','totally','very')"
DAMPENERS = "('barely','hardly','marginally','partly','scarcely','slightly','somewhat')"
NEGATIONS = (
    "('cannot','neither','never','no','nobody','none','nor','not','nothing','nowhere','without',"
    "'ain','aren','couldn','didn','doesn','don','hadn','hasn','haven','isn','mightn','mustn','needn','shan','shouldn',"
    "'wasn','weren','won','wouldn')"
)


def _six(expression: str) -> str:
    """Six places, rounded on the decimal value: binary rounding would send a decimal tie either way."""
    return f"CAST(round(CAST({expression} AS DECIMAL(28, 10)), 6) AS DOUBLE)"


def _tags_of(column: str) -> str:
    return f"list_transform(string_split({column}, '><'), lambda x: replace(replace(x, '>', ''), '<', ''))"


def _prose(column: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({column}, ''), '{CODE}', '', 'g'), '{MARKUP}', '', 'g')"


def _push(column: str, fade: float) -> str:
    return (
        f"CASE WHEN {column} IN {AMPLIFIERS} THEN 0.293 * {fade} "
        f"WHEN {column} IN {DAMPENERS} THEN -0.293 * {fade} ELSE 0 END"
    )


def _delay(asked: str, answered: str) -> str:
    q, a = f"CAST({asked} AS TIMESTAMP)", f"CAST({answered} AS TIMESTAMP)"
    return f"""date_diff('second', {q}, {a}) AS AnswerDurationSeconds,
        date_diff('second', {q}, {a}) / 60.0 AS AnswerDurationMinute,
        date_diff('second', {q}, {a}) / 3600.0 AS AnswerDurationHour,
        CAST(date_diff('day', {q}, {a}) AS INT) AS AnswerDurationDays"""


def _cosine(left: str, right: str, name: str) -> str:
    return f"""SELECT t._Id, coalesce(c.v, 0) AS {name} FROM text_parts t LEFT JOIN (
        SELECT _Id, sum(l * r) / (sqrt(sum(l * idf * l * idf)) * sqrt(sum(r * idf * r * idf))) AS v FROM (
          SELECT _Id, l, r, CASE WHEN l > 0 AND r > 0 THEN 1 ELSE ln(1.5) + 1 END AS idf FROM (
            SELECT _Id, term, sum(l) AS l, sum(r) AS r FROM (
              SELECT _Id, unnest(regexp_extract_all(lower({left}), '{TOKEN}')) AS term, 1.0::DOUBLE AS l, 0.0::DOUBLE AS r FROM text_parts
              UNION ALL
              SELECT _Id, unnest(regexp_extract_all(lower({right}), '{TOKEN}')), 0.0::DOUBLE, 1.0::DOUBLE FROM text_parts)
            GROUP BY _Id, term))
        GROUP BY _Id HAVING sum(l) > 0 AND sum(r) > 0) c USING (_Id)"""


def _popularity(*keys: str) -> str:
    by = ", ".join(keys)
    return f"""SELECT {by}, count(*) AS tag_frequency, quantile_cont(_Score, 0.5)::DOUBLE AS med_score,
        quantile_cont(_AnswerCount, 0.5)::DOUBLE AS med_answer_count,
        {_six('sum(is_answer) / count(*)')} AS percent_answer FROM exploded GROUP BY {by}"""


def _user_metric(table: str, expression: str, name: str, kind: int) -> str:
    value = _six("coalesce(m.v, 0)") if expression.startswith("avg") else "coalesce(m.v, 0)"
    return f"""SELECT u._Id, u._Reputation, {value} AS {name} FROM so_users u LEFT JOIN (
        SELECT _OwnerUserId, {expression} AS v FROM {table} WHERE _PostTypeId = {kind} AND _OwnerUserId IS NOT NULL
        GROUP BY _OwnerUserId) m ON m._OwnerUserId = u._Id"""


VIEWS = {
    "so_users": """SELECT c_custkey AS _Id, CAST(floor(c_acctbal) AS INT) AS _Reputation, c_name AS _DisplayName
        FROM customer""",
    "so_badges": f"""SELECT o_orderkey AS _Id, o_custkey AS _UserId, substr(o_orderpriority, 3) AS _Name,
        strftime(o_orderdate, '{ISO}') AS _Date, CAST(1 + CAST(substr(o_orderpriority, 1, 1) AS INT) % 3 AS INT) AS _Class,
        o_orderkey % 5 = 0 AS _TagBased FROM orders""",
    "answer_rows": f"""SELECT {BASE} + l_orderkey * 10 + l_linenumber AS _Id, l_orderkey AS _ParentId,
        min(l_partkey) AS _OwnerUserId, CAST(max(floor(l_extendedprice)) % 41 - 10 AS INT) AS _Score,
        CAST(max(l_quantity * l_quantity) * l_linenumber * l_linenumber * 7 AS INT) AS delay
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "so_answers": f"""SELECT a._Id, 2 AS _PostTypeId,
        strftime(o.o_orderdate + to_seconds(a.delay), '{ISO}') AS _CreationDate, a._Score, a._OwnerUserId
        FROM answer_rows a JOIN orders o ON o.o_orderkey = a._ParentId""",
    "tag_strings": """SELECT l_orderkey,
        concat('<', array_to_string(list_sort(list(DISTINCT tag)), '><'), '>') AS _Tags FROM (
          SELECT l_orderkey, replace(p_name, ' ', '-') AS tag FROM lineitem JOIN part ON l_partkey = p_partkey
          UNION ALL
          SELECT l_orderkey, lower(p_type) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1)
        GROUP BY l_orderkey""",
    "so_questions": f"""SELECT o_orderkey AS _Id, 1 AS _PostTypeId,
        CASE WHEN o_orderstatus = 'F' THEN a.first_id END AS _AcceptedAnswerId,
        strftime(o_orderdate, '{ISO}') AS _CreationDate,
        CAST(floor(o_totalprice) % 41 - 10 AS INT) AS _Score,
        CAST(floor(o_totalprice / 100) AS INT) AS _ViewCount,
        CASE WHEN o_custkey % 10 <> 3 THEN o_custkey END AS _OwnerUserId, t._Tags,
        CAST(coalesce(a.n, 0) AS INT) AS _AnswerCount
        FROM orders
        LEFT JOIN (SELECT _ParentId, min(_Id) AS first_id, count(*) AS n FROM answer_rows GROUP BY _ParentId) a
          ON a._ParentId = o_orderkey
        LEFT JOIN tag_strings t ON t.l_orderkey = o_orderkey""",
    "so_posts": "SELECT * FROM so_questions UNION ALL BY NAME SELECT * FROM so_answers",
    "so_texts": f"""SELECT d.doc_id AS _Id, 1 AS _PostTypeId,
        CASE WHEN quality = 1 THEN d.doc_id + {BASE} END AS _AcceptedAnswerId, {ASKED} AS _CreationDate,
        CAST(n_chars % 41 - 10 AS INT) AS _Score, CAST(n_chars * 3 AS INT) AS _ViewCount,
        concat('<p>', substr(text, 1, CAST(floor(n_chars * 3 / 4) AS INT)), '</p>',
          CASE WHEN d.doc_id % 3 = 0
          THEN concat('<pre><code>', substr(text, CAST(floor(n_chars * 3 / 4) AS INT) + 1), '</code></pre>')
          ELSE concat('<p>', substr(text, CAST(floor(n_chars * 3 / 4) AS INT) + 1), '</p>') END) AS _Body,
        split_part(text, chr(10), 1) AS _Title, concat('<', lang, '><', source, '>') AS _Tags,
        CAST(CASE WHEN quality IS NULL THEN 0 ELSE 1 + toxic END AS INT) AS _AnswerCount,
        CAST(CASE WHEN d.doc_id % 5 <> 0 THEN d.doc_id % 7 END AS INT) AS _CommentCount,
        CAST(CASE WHEN d.doc_id % 4 = 0 THEN n_chars % 11 END AS INT) AS _FavoriteCount
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "text_answers": f"""SELECT d.doc_id + {BASE} AS AnswerId,
        strftime(CAST({ASKED} AS TIMESTAMP) + to_seconds(n_chars * n_chars % 2000000 + d.doc_id % 60), '{ISO}')
          AS AcceptedAnswerCreationDate
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1 AND d.doc_id % 13 <> 0""",
    "so_markup": "SELECT _Id, _Body FROM so_texts UNION ALL SELECT -1 - page_id, html FROM pages",
    "lexicon": f"""SELECT term, sum(quality) * 2.0::DOUBLE / count(*) - 1.7::DOUBLE AS valence FROM (
        SELECT d.doc_id, quality, unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS term
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id) GROUP BY term""",
    "base": """SELECT _Id, _PostTypeId, _AcceptedAnswerId, _ViewCount, _Score, _Tags, _AnswerCount,
        CASE WHEN _AcceptedAnswerId IS NULL THEN 0 ELSE 1 END AS is_answer,
        CAST(year(CAST(_CreationDate AS TIMESTAMP)) AS INT) AS Year,
        CAST(month(CAST(_CreationDate AS TIMESTAMP)) AS INT) AS Month FROM so_questions""",
    "tagged": f"""SELECT * EXCLUDE (_Tags), {_tags_of('_Tags')} AS tags_arr,
        CAST(len(list_distinct({_tags_of('_Tags')})) AS INT) AS TagCountPerPost FROM base""",
    "exploded": """SELECT _Id, _ViewCount, _Score, _AnswerCount, is_answer, Year, Month, TagCountPerPost,
        unnest(tags_arr) AS Tag FROM tagged""",
    "frequency": "SELECT Tag, count(*) AS tag_frequency FROM exploded GROUP BY Tag",
    "yearly": "SELECT Tag, Year, count(*) AS tag_frequency FROM exploded GROUP BY Tag, Year",
    "ranked": """SELECT Tag, tag_frequency, CAST(row_number() OVER (ORDER BY tag_frequency DESC, Tag) AS INT) AS rank
        FROM frequency""",
    "cumulative": """SELECT Tag, tag_frequency, tag_frequency / sum(tag_frequency) OVER () AS rel_frequency,
        sum(tag_frequency) OVER (ORDER BY tag_frequency DESC) / sum(tag_frequency) OVER () AS cum_frequency
        FROM frequency""",
    "per_question": """SELECT TagCountPerPost, count(*) AS num_question,
        CAST(sum(is_answer) AS BIGINT) AS num_question_with_answer,
        CAST(count(*) - sum(is_answer) AS BIGINT) AS num_without_answer,
        round(count(*) / (SELECT count(*) FROM base), 4) AS percent_all,
        round(sum(is_answer) / count(*), 4) AS percent_answer,
        round(1 - round(sum(is_answer) / count(*), 4), 6) AS percent_without_answer
        FROM tagged WHERE TagCountPerPost IS NOT NULL GROUP BY TagCountPerPost""",
    "popularity": _popularity("Tag"),
    "delays": f"""SELECT q._Id AS QuestionId, q._ViewCount, q._Score, q._Tags, q._AnswerCount, a._Id AS AnswerId,
        CAST(year(CAST(q._CreationDate AS TIMESTAMP)) AS INT) AS Year,
        {_delay('q._CreationDate', 'a._CreationDate')}
        FROM so_questions q JOIN so_answers a ON q._AcceptedAnswerId = a._Id""",
    "response": f"""SELECT Tag, count(*) AS tag_frequency, quantile_cont(_Score, 0.5)::DOUBLE AS med_score,
        quantile_cont(_AnswerCount, 0.5)::DOUBLE AS med_answer_count,
        quantile_cont(AnswerDurationSeconds, 0.5)::DOUBLE AS med_AnswerDurationSeconds,
        {_six('quantile_cont(AnswerDurationSeconds / 3600, 0.5)')} AS med_AnswerDurationHour,
        quantile_cont(AnswerDurationDays, 0.5)::DOUBLE AS med_AnswerDurationDays,
        {_six('avg(AnswerDurationSeconds)')} AS avg_AnswerDurationSeconds,
        {_six('avg(AnswerDurationSeconds) / 3600')} AS avg_AnswerDurationHour,
        {_six('avg(AnswerDurationDays)')} AS avg_AnswerDurationDays
        FROM (SELECT *, unnest({_tags_of('_Tags')}) AS Tag FROM delays) GROUP BY Tag""",
    "user_badges": """SELECT u._Id, u._Reputation, coalesce(n, 0) AS count_all_badges, coalesce(gold, 0) AS count_gold,
        coalesce(silver, 0) AS count_silver, coalesce(bronze, 0) AS count_bronze FROM so_users u LEFT JOIN (
          SELECT _UserId, count(*) AS n, count(*) FILTER (WHERE _Class = 1) AS gold,
          count(*) FILTER (WHERE _Class = 2) AS silver, count(*) FILTER (WHERE _Class = 3) AS bronze
          FROM so_badges GROUP BY _UserId) b ON b._UserId = u._Id""",
    "user_answer_score_sum": _user_metric("so_posts", "CAST(sum(_Score) AS BIGINT)", "sum_score", 2),
    "user_answer_score_avg": _user_metric("so_posts", "avg(_Score)", "avg_score", 2),
    "user_question_score_sum": _user_metric("so_posts", "CAST(sum(_Score) AS BIGINT)", "sum_score", 1),
    "user_question_score_avg": _user_metric("so_posts", "avg(_Score)", "avg_score", 1),
    "user_question_views": _user_metric("so_posts", "CAST(sum(_ViewCount) AS BIGINT)", "sum_viewcount", 1),
    "user_accepted_answers": """SELECT g._Id, g.count_accepted_answer, u._Reputation FROM (
        SELECT p._OwnerUserId AS _Id, count(*) AS count_accepted_answer FROM so_posts q JOIN so_posts p
        ON q._AcceptedAnswerId = p._Id WHERE p._OwnerUserId IS NOT NULL GROUP BY p._OwnerUserId) g
        LEFT JOIN so_users u ON u._Id = g._Id""",
    "user_answered_share": """SELECT g.*, round(question_answered / question_asked, 4) AS percent_answered, u._Reputation
        FROM (SELECT _OwnerUserId, count(*) AS question_asked, count(_AcceptedAnswerId) AS question_answered
          FROM so_posts WHERE _PostTypeId = 1 AND _OwnerUserId IS NOT NULL GROUP BY _OwnerUserId) g
        LEFT JOIN so_users u ON u._Id = g._OwnerUserId""",
    "text_parts": f"""SELECT _Id, {_prose('_Body')} AS text, {_prose('_Title')} AS title,
        concat(array_to_string({_tags_of('_Tags')}, ' '), ' ') AS tags FROM so_texts""",
    "counts": f"""SELECT _Id, CAST(len(ws) AS INT) AS words, CAST(length(text) AS INT) AS characters,
        CAST(CASE WHEN len(ws) = 0 THEN 0
          ELSE greatest(len(regexp_extract_all(text, '[.!?]+(?:[{WHITE}]|\\z)')), 1) END AS INT) AS sentences,
        CAST(coalesce(list_sum(ds), 0) + CASE WHEN ds[1] = 0 THEN 1 ELSE 0 END AS INT) AS syllables FROM (
          SELECT *, list_transform(ws, lambda w: len(regexp_extract_all(w, '[aeiouy]+'))
            - CASE WHEN w LIKE '%e' THEN 1 ELSE 0 END + CASE WHEN w LIKE '%le' THEN 1 ELSE 0 END) AS ds
          FROM (SELECT _Id, text, regexp_extract_all(text, '[^{WHITE}]+') AS ws FROM text_parts))""",
    "readability": """SELECT _Id,
        CASE WHEN words = 0 OR sentences = 0 THEN -999
          ELSE 0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59 END AS Flesch_Kincard_Grade,
        CASE WHEN words = 0 OR sentences = 0 THEN -999
          ELSE 206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words) END AS Flesch_reading_ease,
        CASE WHEN words = 0 THEN -999
          ELSE 0.0588 * (characters / words * 100) - 0.296 * (sentences / words * 100) - 15.8 END AS Coleman_Liau_index
        FROM counts""",
    "code": f"""SELECT _Id, CAST(code_chars AS INT) AS code_chars, CAST(text_chars AS INT) AS text_chars,
        CASE WHEN code_chars = 0 THEN 0 ELSE code_chars / (text_chars + code_chars) END AS code_percentage FROM (
          SELECT _Id, length({_prose('_Body')}) AS text_chars,
          length(replace(replace(array_to_string(regexp_extract_all(_Body, '{CODE}'), ''), '<code>', ''), '</code>', ''))
            AS code_chars FROM so_texts)""",
    "cosine_post": _cosine("title", "text", "cos_sim_post_title"),
    "cosine_tags": _cosine("title", "tags", "cos_sim_title_tag"),
    "placed": f"""SELECT _Id, term, lag(term, 1) OVER w AS b1, lag(term, 2) OVER w AS b2, lag(term, 3) OVER w AS b3
        FROM (SELECT _Id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos
          FROM (SELECT _Id, regexp_extract_all(lower(text), '{TOKEN}') AS ts FROM text_parts))
        WINDOW w AS (PARTITION BY _Id ORDER BY pos)""",
    "sentiments": f"""SELECT t._Id, coalesce(v.s / sqrt(v.s * v.s + 15), 0) AS sentiment FROM text_parts t LEFT JOIN (
        SELECT _Id, sum((valence + sign(valence) * ({_push('b1', 1.0)} + {_push('b2', 0.95)} + {_push('b3', 0.9)}))
          * CASE WHEN b1 IN {NEGATIONS} OR b2 IN {NEGATIONS} OR b3 IN {NEGATIONS} THEN -0.74 ELSE 1 END) AS s
        FROM placed JOIN lexicon USING (term) GROUP BY _Id) v USING (_Id)""",
    "metrics": "SELECT c._Id, "
    + ", ".join(f"CASE WHEN words > 10 THEN {m} ELSE 0 END AS {m}" for m in METRICS)
    + """ FROM counts c JOIN readability USING (_Id) JOIN code USING (_Id) JOIN cosine_post USING (_Id)
        JOIN cosine_tags USING (_Id) JOIN sentiments USING (_Id)""",
    "metrics9": "SELECT _Id, " + ", ".join(f"round({m}, 9) AS {m}" for m in METRICS) + " FROM metrics",
    "delayed": f"""SELECT m.*, q._AcceptedAnswerId, q._Score, q._ViewCount, q._AnswerCount,
        {_delay('q._CreationDate', 'a.AcceptedAnswerCreationDate')}
        FROM metrics m JOIN so_texts q USING (_Id) LEFT JOIN text_answers a ON a.AnswerId = q._AcceptedAnswerId""",
    "outcomes": """SELECT _Id, CASE WHEN coalesce(_AnswerCount, 0) = 0 THEN 'Unanswered'
        WHEN _AcceptedAnswerId IS NULL THEN 'Answered' ELSE 'BestAnswered' END AS target FROM so_texts""",
    "features": "SELECT _Id, _AcceptedAnswerId, "
    + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in COUNTERS)
    + ", "
    + ", ".join(f"CAST({m} AS DOUBLE) AS {f}" for m, f in zip(METRICS, FEATURES))
    + ", target FROM metrics JOIN so_texts USING (_Id) JOIN outcomes USING (_Id)",
    "tag_terms": f"""SELECT Tag, tag_frequency, term, count(*) AS tf FROM (
        SELECT Tag, tag_frequency, unnest(regexp_extract_all(lower(Tag), '{TOKEN}')) AS term FROM frequency)
        GROUP BY Tag, tag_frequency, term""",
    "weights": """SELECT Tag, term, tf * (ln((1 + (SELECT sum(tag_frequency) FROM frequency)) / (1 + df)) + 1) AS w
        FROM tag_terms JOIN (SELECT term, sum(tag_frequency) AS df FROM tag_terms GROUP BY term) USING (term)""",
}


KMEANS_STEPS = 30


def _lloyd_views() -> dict[str, str]:
    """Every step of K-means: the centres of the members so far, and each tag's nearest centre among all of them."""
    arrival = "-ln((('0x' || substr(md5('0|' || Tag), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / tag_frequency"
    views = {
        "vectors": """SELECT Tag, tag_frequency, term, coalesce(w / sqrt(sum(w * w) OVER (PARTITION BY Tag)), 0) AS weight
        FROM frequency LEFT JOIN weights USING (Tag)""",
        "members0": f"""SELECT Tag, CAST(row_number() OVER (ORDER BY {arrival}, Tag) - 1 AS INT) AS cluster
        FROM frequency ORDER BY {arrival}, Tag LIMIT 20""",
    }
    for i in range(1, KMEANS_STEPS + 2):
        before = f"members{i - 1}"
        views[f"centres{i}"] = f"""SELECT cluster, term, sum(tag_frequency * weight) / any_value(size) AS centre
        FROM {before} JOIN vectors USING (Tag) JOIN (SELECT cluster, sum(tag_frequency) AS size FROM {before}
          JOIN frequency USING (Tag) GROUP BY cluster) USING (cluster) GROUP BY cluster, term"""
        views[f"members{i}"] = f"""SELECT Tag, cluster FROM (
          SELECT Tag, cluster, row_number() OVER (PARTITION BY Tag ORDER BY round(norm - 2 * coalesce(dot, 0), 9), cluster) AS place
          FROM frequency CROSS JOIN (SELECT cluster, sum(centre * centre) AS norm FROM centres{i} GROUP BY cluster)
          LEFT JOIN (SELECT v.Tag, cluster, sum(weight * centre) AS dot FROM vectors v JOIN centres{i} USING (term)
            GROUP BY v.Tag, cluster) USING (Tag, cluster)) WHERE place = 1"""
    views["clustered"] = f"SELECT Tag, tag_frequency, cluster FROM frequency JOIN members{KMEANS_STEPS} USING (Tag)"
    return views


VIEWS |= _lloyd_views()

SQUARINGS = 24


def _components(columns, k: int, table: str) -> str:
    """The first components of a table's correlations as rows of pc, feature, loading, variance and share of all.

    A matrix squared again and again comes down to its leading vector; that component is then taken out of the matrix, and the next one follows.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = ", ".join(f"corr({a}, {b}) AS {a}__{b}" for a, b in pairs)
    entries = " UNION ALL ".join(
        f"SELECT '{a}' AS i, '{b}' AS j, CASE WHEN isnan({a}__{b}) THEN 0 ELSE coalesce({a}__{b}, 0) END AS v FROM sums"
        + (f" UNION ALL SELECT '{b}', '{a}', CASE WHEN isnan({a}__{b}) THEN 0 ELSE coalesce({a}__{b}, 0) END FROM sums" if a != b else "")
        for a, b in pairs
    )
    steps = [f"sums AS MATERIALIZED (SELECT {sums} FROM {table})", f"m1 AS MATERIALIZED ({entries})"]
    for c in range(1, k + 1):
        last = f"m{c}"
        for n in range(1, SQUARINGS + 1):
            steps.append(
                f"m{c}_{n} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) / (SELECT sum(v * v) FROM {last}) AS v"
                f" FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY a.i, b.j)"
            )
            last = f"m{c}_{n}"
        steps.append(
            f"raw{c} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS x FROM {last}"
            f" WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY v DESC LIMIT 1))"
        )
        steps.append(f"v{c} AS MATERIALIZED (SELECT i, x * (SELECT sign(arg_max(x, abs(x))) FROM raw{c}) AS x FROM raw{c})")
        steps.append(f"l{c} AS MATERIALIZED (SELECT sum(a.x * v * b.x) AS l FROM v{c} a JOIN m{c} ON m{c}.i = a.i JOIN v{c} b ON b.i = m{c}.j)")
        steps.append(
            f"m{c + 1} AS MATERIALIZED (SELECT m.i, m.j, m.v - l * a.x * b.x AS v FROM m{c} m JOIN v{c} a ON a.i = m.i"
            f" JOIN v{c} b ON b.i = m.j CROSS JOIN l{c})"
        )
    found = " UNION ALL ".join(
        f"SELECT 'PC{c}' AS pc, i AS feature, x AS loading, l AS variance, l / (SELECT sum(v) FROM m1 WHERE i = j) AS share FROM v{c} CROSS JOIN l{c}"
        for c in range(1, k + 1)
    )
    return f"WITH {', '.join(steps)} {found}"


def _variances(table: str) -> str:
    shares = f"(SELECT DISTINCT pc, share FROM {table})"
    return f"""SELECT pc, {_six('share')} AS ratio_total, {_six('sum(share) OVER (ORDER BY pc)')} AS cum_total,
        {_six('share / sum(share) OVER ()')} AS ratio_kept FROM {shares}"""


def _scores(columns) -> str:
    scaled = " UNION ALL ".join(
        f"SELECT _Id, target, '{f}' AS feature, coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_samp({f}) OVER (), 0), 0) AS z FROM features" for f in columns
    )
    sums = ", ".join(f"sum(z * loading) FILTER (WHERE pc = 'PC{i + 1}') AS PC{i + 1}" for i in range(len(columns)))
    return f"SELECT _Id, target, {sums} FROM ({scaled}) JOIN components USING (feature) GROUP BY _Id, target"


VIEWS |= {
    "features9": "SELECT *, CAST(dense_rank() OVER (ORDER BY target) - 1 AS INT) AS target_cat FROM features",
    "components": _components(FEATURES, len(FEATURES), "features"),
    "components9": _components((*FEATURES, "_Score", "target_cat"), 3, "features9"),
    "scores": _scores(FEATURES),
}
PCS = tuple(f"PC{i + 1}" for i in range(len(FEATURES)))
LOADINGS = f"SELECT pc, feature, {_six('loading')} AS loading FROM components"

CLUSTER_SIZES = "SELECT cluster, CAST(sum(tag_frequency) AS BIGINT) AS n_rows, count(*) AS n_tags FROM clustered GROUP BY cluster"
CLUSTER_WORDS = "SELECT cluster, Tag, tag_frequency AS n FROM clustered"


def _chosen(share: float) -> str:
    """Whether a row is in the sample: the start of a hash of its id, as a part of one, is below the share."""
    return f"('0x' || substr(md5('1|' || _Id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < {share}::DOUBLE"


def _select(columns, table: str, keep: str = "_Id") -> str:
    return f"SELECT {keep}, " + ", ".join(f"{_six(c)} AS {c}" for c in columns) + f" FROM {table}"


def _correlations(columns, table: str) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {_six(f'CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END')} AS r"
        f" FROM {table}"
        for a, b in pairs
    )


def _regressions(columns, table: str) -> str:
    fits = []
    for y in columns:
        x = "_Reputation"
        slope = f"covar_pop({y}, {x}) / nullif(var_pop({x}) FILTER (WHERE {y} IS NOT NULL), 0)"
        middle = f"avg({y}) FILTER (WHERE {x} IS NOT NULL) - {slope} * avg({x}) FILTER (WHERE {y} IS NOT NULL)"
        r2 = f"CASE WHEN isnan(corr({y}, {x})) THEN NULL ELSE pow(corr({y}, {x}), 2) END"
        fits.append(
            f"SELECT '{y}' AS metric, {_six(slope)} AS slope, {_six(middle)} AS intercept,"
            f" {_six(r2)} AS r2 FROM {table}"
        )
    return " UNION ALL ".join(fits)


def _histogram(column: str, table: str, edges: str) -> str:
    """``edges`` is a list expression, or a scalar query that gives one."""
    return f"""SELECT e.bin, {_six('e.lo')} AS lo, {_six('e.hi')} AS hi, count(v.v) AS n_rows FROM (
        SELECT CAST(i AS INT) AS bin, l[i] AS lo, l[i + 1] AS hi
        FROM (SELECT l, unnest(range(1, len(l))) AS i FROM (SELECT {edges} AS l))) e
        LEFT JOIN (SELECT CAST({column} AS DOUBLE) AS v FROM {table}) v
        ON (v.v > e.lo OR (e.bin = 1 AND v.v = e.lo)) AND v.v <= e.hi GROUP BY e.bin, e.lo, e.hi"""


def _spread(column: str, bins: int, low: str) -> str:
    inner = ", ".join(f"lo + (hi - lo) * ({i}::DOUBLE / {bins}::DOUBLE)" for i in range(1, bins))
    table = f"(SELECT {low} AS lo, max({column}) AS hi FROM metrics9)"
    return _histogram(column, "metrics9", f"(SELECT [lo, {inner}, hi] FROM {table})")


def _numbers(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def _trend(first: int, last: int) -> str:
    years = ", ".join(f"CAST(sum(y.tag_frequency) FILTER (WHERE Year = {y}) AS BIGINT) AS y{y}" for y in range(1995, 2002))
    return f"""SELECT Tag, rank, {years} FROM yearly y JOIN ranked r USING (Tag)
        WHERE Year BETWEEN 1995 AND 2001 AND rank BETWEEN {first} AND {last} GROUP BY Tag, rank"""


def _head(cutoff: float) -> str:
    return f"""SELECT Tag, tag_frequency, {_six('rel_frequency')} AS rel_frequency, {_six('cum_frequency')} AS cum_frequency
        FROM cumulative WHERE round(cum_frequency, 12) <= {cutoff}"""


def _top_users(metrics: dict[str, str]) -> str:
    lists = [
        f"""SELECT * FROM (SELECT '{name}' AS metric, _Id, _Reputation, CAST({column} AS DOUBLE) AS value
        FROM {view} ORDER BY {column} DESC, _Id LIMIT 10)"""
        for name, (view, column) in metrics.items()
    ]
    return " UNION ALL ".join(lists)


BADGE_COLUMNS = ("_Reputation", "count_all_badges", "count_gold", "count_silver", "count_bronze")
USER_METRICS = {
    "badges": BADGE_COLUMNS[1:],
    "answer_score_sum": ("sum_score",),
    "answer_score_avg": ("avg_score",),
    "accepted_answers": ("count_accepted_answer",),
    "question_score_sum": ("sum_score",),
    "question_score_avg": ("avg_score",),
    "question_views": ("sum_viewcount",),
    "answered_share": ("question_asked", "question_answered", "percent_answered"),
}
USER_CAPS = {
    "badges": "count_all_badges <= 5000",
    "answer_score_sum": "sum_score <= 150000",
    "answer_score_avg": "avg_score <= 3000",
    "accepted_answers": "count_accepted_answer <= 15000",
    "question_score_sum": "sum_score <= 20000",
    "question_score_avg": "avg_score <= 3000",
    "question_views": "sum_viewcount <= 20000000",
    "answered_share": "question_asked <= 1500",
}


def _box(columns, table: str) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS metric, q1, median, q3,
            CAST(min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_low,
            CAST(max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_high,
            count(*) FILTER (WHERE v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
            FROM (SELECT {c} AS v FROM {table}), (SELECT quantile_cont({c}, 0.25)::DOUBLE AS q1,
            quantile_cont({c}, 0.5)::DOUBLE AS median, quantile_cont({c}, 0.75)::DOUBLE AS q3 FROM {table})
            GROUP BY q1, median, q3"""
        )
    return " UNION ALL ".join(parts)


def _equal_width(columns, table: str) -> str:
    parts = [
        f"""SELECT '{c}' AS metric, CAST(least(CASE WHEN hi = lo THEN 0 ELSE
            floor((v - lo) / ((hi - lo) / 10::DOUBLE)) END, 9) AS INT) AS bin, count(*) AS n_rows
            FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {table}),
            (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {table}) GROUP BY ALL"""
        for c in columns
    ]
    return " UNION ALL ".join(parts)


def _ranges(columns, table: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, {_six(f'min({c})')} AS min_value,
        {_six(f'max({c})')} AS max_value, count({c}) AS n_values FROM {table}"""
        for c in columns
    )


BASE_COLUMNS = ("_Id", "_PostTypeId", "_AcceptedAnswerId", "_ViewCount", "_Score", "_Tags", "_AnswerCount", "is_answer", "Year", "Month")

QUERIES = {
    "ingest_tags": """SELECT p_partkey AS _Id, replace(p_name, ' ', '-') AS _TagName, p_size AS _Count,
        CASE WHEN p_size % 2 = 0 THEN p_partkey * 2 END AS _ExcerptPostId,
        CASE WHEN p_size % 3 = 0 THEN p_partkey * 3 END AS _WikiPostId FROM part""",
    "ingest_postlinks": f"""SELECT o_orderkey AS _Id, strftime(o_orderdate, '{ISO}') AS _CreationDate,
        o_orderkey AS _PostId, o_custkey AS _RelatedPostId,
        CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 1 END AS _LinkTypeId FROM orders""",
    "ingest_badges": "SELECT * FROM so_badges",
    "ingest_users": """SELECT *, CAST(_Reputation % 97 AS INT) AS _Views, CAST(_Reputation % 31 AS INT) AS _UpVotes,
        CAST(_Reputation % 13 AS INT) AS _DownVotes, printf('%04d-01-02T03:04:05.678', 2008 + _Id % 10) AS _CreationDate,
        CASE WHEN _Id % 3 <> 0 THEN '2021-02-03T04:05:06.789' END AS _LastAccessDate, concat('<b>', _DisplayName, '</b> & "more"') AS _AboutMe FROM so_users""",
    "ingest_posts": "SELECT * FROM so_posts UNION ALL BY NAME SELECT * FROM so_texts",
    "parquet_roundtrip": "SELECT * FROM popularity",
    "parquet_multi_path": "SELECT _Id, _PostTypeId, _CreationDate, _Score FROM so_posts",
    "parquet_overwrite": """SELECT _Id, _PostTypeId, _AcceptedAnswerId, _Score FROM so_questions
        WHERE _AcceptedAnswerId IS NOT NULL""",
    "csv_roundtrip": _head(0.9),
    "question_base": "SELECT * FROM base",
    "answer_base": "SELECT _Id AS AnswerId, _CreationDate AS AcceptedAnswerCreationDate FROM so_answers",
    "accepted_questions": "SELECT _Id, _AcceptedAnswerId, _Score FROM so_questions WHERE _AcceptedAnswerId IS NOT NULL",
    "questions_since_year": """SELECT _Id, _CreationDate, _Score FROM so_questions
        WHERE year(CAST(_CreationDate AS TIMESTAMP)) > 1998""",
    "question_outcome": "SELECT * FROM outcomes",
    "outcome_counts": "SELECT target, count(*) AS n_questions FROM outcomes GROUP BY target",
    "outcome_index": "SELECT _Id, target, CAST(dense_rank() OVER (ORDER BY target) - 1 AS INT) AS target_cat FROM outcomes",
    "post_counts": """SELECT count(*) AS posts, count(*) FILTER (WHERE _PostTypeId = 1) AS questions,
        count(*) FILTER (WHERE _PostTypeId = 2) AS answers,
        count(*) FILTER (WHERE _PostTypeId = 1 AND _AcceptedAnswerId IS NOT NULL) AS accepted_questions,
        count(*) FILTER (WHERE _PostTypeId = 1 AND _AcceptedAnswerId IS NULL) AS not_accepted_questions,
        count(*) FILTER (WHERE _PostTypeId = 1 AND coalesce(_AnswerCount, 0) = 0) AS unanswered_questions FROM so_posts""",
    "questions_per_year": "SELECT Year, count(*) AS n_questions FROM base GROUP BY Year",
    "answer_delay": f"""SELECT * EXCLUDE (AnswerDurationMinute, AnswerDurationHour),
        {_six('AnswerDurationMinute')} AS AnswerDurationMinute, {_six('AnswerDurationHour')} AS AnswerDurationHour FROM delays""",
    "question_at_delay": f"""SELECT * EXCLUDE (_Tags, AnswerDurationMinute, AnswerDurationHour),
        {_six('AnswerDurationMinute')} AS AnswerDurationMinute, {_six('AnswerDurationHour')} AS AnswerDurationHour FROM delays
        WHERE AnswerDurationDays = 5 ORDER BY QuestionId LIMIT 1""",
    "tag_text": f"""SELECT _Id, CASE WHEN _Tags IS NOT NULL
        THEN concat(array_to_string({_tags_of('_Tags')}, ' '), ' ') END AS tag_text FROM so_questions""",
    "tags_questions": "SELECT * EXCLUDE (tags_arr), array_to_string(tags_arr, ',') AS tags_arr FROM tagged",
    "tags_distribution": "SELECT * FROM exploded",
    "top_tags": "SELECT * FROM popularity",
    "top_tags_year": _popularity("Tag", "Year"),
    "tags_num": "SELECT * FROM per_question",
    "tags_num_rows": """SELECT TagCountPerPost, round(count(*) / (SELECT count(*) FROM base), 4) AS percent_all,
        round(sum(is_answer) / count(*), 4) AS percent_answer FROM exploded GROUP BY TagCountPerPost""",
    "tags_num_long": """SELECT TagCountPerPost, 'num_question_with_answer' AS outcome,
        num_question_with_answer AS n_questions FROM per_question
        UNION ALL SELECT TagCountPerPost, 'num_without_answer', num_without_answer FROM per_question""",
    "tag_rel_frequency": f"SELECT Tag, tag_frequency, {_six('rel_frequency')} AS rel_frequency FROM cumulative",
    "tag_cum_frequency": f"""SELECT Tag, tag_frequency, {_six('rel_frequency')} AS rel_frequency,
        {_six('cum_frequency')} AS cum_frequency FROM cumulative""",
    "top_tags_80": _head(0.80),
    "top_tags_85": _head(0.85),
    "top_tags_90": _head(0.90),
    "tag_rank_slices": "SELECT * FROM ranked WHERE rank <= 60",
    "tag_trend_1_20": _trend(1, 20),
    "tag_trend_21_40": _trend(21, 40),
    "tag_trend_41_60": _trend(41, 60),
    "tag_trend_keyword": "SELECT Tag, "
    + ", ".join(f"CAST(sum(y.tag_frequency) FILTER (WHERE Year = {y}) AS BIGINT) AS y{y}" for y in range(1995, 2002))
    + """ FROM yearly y JOIN cumulative c USING (Tag) WHERE Year BETWEEN 1995 AND 2001
        AND round(cum_frequency, 12) <= 0.9 AND Tag ILIKE '%rod%' GROUP BY Tag""",
    "tag_trend_keyword_n": """SELECT count(DISTINCT Tag) AS n_tags FROM yearly y JOIN cumulative c USING (Tag)
        WHERE Year BETWEEN 1995 AND 2001 AND round(cum_frequency, 12) <= 0.9 AND Tag ILIKE '%rod%'""",
    "tag_null_audit": "SELECT count(*) AS n_rows, "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS nulls_{c}" for c in BASE_COLUMNS)
    + ", count(*) FILTER (WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in BASE_COLUMNS) + ") AS complete_rows FROM base",
    "top_tags_response": "SELECT * FROM response",
    "top20_tags_answered": """SELECT Tag, tag_frequency, percent_answer FROM popularity
        ORDER BY tag_frequency DESC, Tag LIMIT 20""",
    "top20_tags_wait": """SELECT Tag, tag_frequency, med_AnswerDurationHour, avg_AnswerDurationHour FROM response
        ORDER BY tag_frequency DESC, Tag LIMIT 20""",
    **{f"user_{name}": f"SELECT * FROM user_{name}" for name in USER_METRICS},
    **{
        f"corr_user_{name}": _correlations(
            ("_Reputation", *columns), f"(SELECT * FROM user_{name} WHERE {USER_CAPS[name]})"
        )
        for name, columns in USER_METRICS.items()
    },
    **{
        f"regr_user_{name}": _regressions(columns, f"(SELECT * FROM user_{name} WHERE {USER_CAPS[name]})")
        for name, columns in USER_METRICS.items()
    },
    "user_metric_trimmed": "SELECT * FROM user_badges WHERE count_all_badges <= 6",
    "user_badges_box": _box(BADGE_COLUMNS, "user_badges"),
    "user_badges_hist": _equal_width(BADGE_COLUMNS, "user_badges"),
    "top_users_by_metric": _top_users(
        {
            "answer_sum_score": ("user_answer_score_sum", "sum_score"),
            "answer_avg_score": ("user_answer_score_avg", "avg_score"),
            "question_sum_score": ("user_question_score_sum", "sum_score"),
            "question_avg_score": ("user_question_score_avg", "avg_score"),
            "question_sum_viewcount": ("user_question_views", "sum_viewcount"),
        }
    ),
    "text_clean": f"SELECT _Id, {_prose('_Body')} AS text FROM so_markup",
    "text_clean_with_code": f"SELECT _Id, regexp_replace(_Body, '{MARKUP}', '', 'g') AS text FROM so_markup",
    "text_counts": "SELECT * FROM counts",
    "readability": _select(METRICS[:3], "readability"),
    "code_share": _select(("code_percentage",), "code", "_Id, code_chars, text_chars"),
    "cosine_post_title": _select(("cos_sim_post_title",), "cosine_post"),
    "cosine_tags_title": _select(("cos_sim_title_tag",), "cosine_tags"),
    "sentiment_lexicon": _select(("sentiment",), "sentiments"),
    "question_metrics": _select(METRICS, "metrics"),
    "question_metrics_delay": _select(
        (*METRICS, *DELAYS[1:3]),
        "delayed",
        "_Id, _AcceptedAnswerId, _Score, _ViewCount, _AnswerCount, AnswerDurationSeconds, AnswerDurationDays",
    ),
    "metric_ranges": _ranges((*METRICS, *DELAYS), "delayed"),
    "positive_share": "SELECT "
    + ", ".join(
        f"{_six(f'count({c}) FILTER (WHERE round(sentiment, 9) >= 0.5) / count({c})')} AS share_{c}"
        for c in (*METRICS, *DELAYS)
    )
    + " FROM delayed",
    "hist_delay_hours": _histogram("AnswerDurationHour", "delays", _numbers(range(25))),
    "hist_delay_minutes": _histogram("AnswerDurationMinute", "delays", _numbers(range(61))),
    "hist_delay_days": _histogram(
        "AnswerDurationDays",
        "delays",
        "(SELECT CASE WHEN max(AnswerDurationDays) > 7 THEN list_append([0, 1, 2, 3, 4, 5, 6, 7]::DOUBLE[], "
        "max(AnswerDurationDays)::DOUBLE) ELSE [0, 1, 2, 3, 4, 5, 6, 7]::DOUBLE[] END FROM delays)",
    ),
    "hist_delay_seconds": _histogram("AnswerDurationSeconds", "delays", _numbers([0, 1, *range(6, 61, 6)])),
    "hist_code_share": _spread("code_percentage", 10, "0.0::DOUBLE"),
    "hist_cos_post_title": _spread("cos_sim_post_title", 9, "min(cos_sim_post_title)"),
    "hist_cos_title_tag": _spread("cos_sim_title_tag", 9, "min(cos_sim_title_tag)"),
    "hist_ease": _histogram("Flesch_reading_ease", "metrics9", _numbers(i * 10 for i in range(11))),
    "hist_grade": _histogram("Flesch_Kincard_Grade", "metrics9", _numbers(i * 19 / 9 for i in range(10))),
    "hist_coleman": _histogram("Coleman_Liau_index", "metrics9", _numbers(range(1, 21))),
    "hist_sentiment": _histogram(
        "sentiment",
        "metrics9",
        _numbers([i / 10 for i in range(-10, 0)] + [-0.05, 0.05] + [i / 10 for i in range(1, 11)]),
    ),
    "corr_slow_questions": _correlations(SLOW, "(SELECT * FROM delayed WHERE AnswerDurationDays > 1)"),
    "question_features": _select((*COUNTERS, *FEATURES), "features", "_Id, _AcceptedAnswerId, target"),
    "corr_features": _correlations(FEATURES, "features"),
    "corr_features9": _correlations(
        (*FEATURES, "_Score", "target_cat"),
        "(SELECT *, CAST(dense_rank() OVER (ORDER BY target) - 1 AS INT) AS target_cat FROM features)",
    ),
    "pca_correlation": _correlations(FEATURES, "features"),
    "pca_scores": _select(PCS, "scores", "_Id, target"),
    "pca_saved_scores": _select(PCS, "scores", "_Id, target"),
    "pca_scores_sample": _select(PCS, "scores", "_Id, target") + " ORDER BY ('0x' || substr(md5('1|' || _Id), 1, 8))::BIGINT, _Id LIMIT 1000",
    "pca_score_moments": f"""SELECT DISTINCT pc, 0.0::DOUBLE AS mean, {_six('variance')} AS variance, 0.0::DOUBLE AS most_shared FROM components""",
    "pca_variance": _variances("components"),
    "pca_loadings": LOADINGS,
    "pca_model_roundtrip": LOADINGS,
    "pca3_variance": _variances("components9"),
    "pca3_loadings": f"SELECT pc, feature, {_six('loading')} AS loading FROM components9",
    "stratified_sample": f"""SELECT _Id, _Score, CAST(year(CAST(_CreationDate AS TIMESTAMP)) AS INT) AS Year FROM so_texts
        WHERE {_chosen(0.1)} AND year(CAST(_CreationDate AS TIMESTAMP)) BETWEEN 2012 AND 2021""",
    "features_scaled": "SELECT _Id, "
    + ", ".join(f"{_six(f'coalesce(({f} - m.{f}_m) / nullif(m.{f}_d, 0), 0)')} AS {f}" for f in FEATURES)
    + " FROM features, (SELECT "
    + ", ".join(f"avg({f}) AS {f}_m, stddev_samp({f}) AS {f}_d" for f in FEATURES)
    + " FROM features) m",
    "tag_tfidf": f"SELECT Tag, term, {_six('w / sqrt(sum(w * w) OVER (PARTITION BY Tag))')} AS weight FROM weights",
    "tag_kmeans": "SELECT Tag, tag_frequency, cluster FROM clustered",
    "kmeans_misplaced": f"""SELECT count(*) AS n_tags, count(*) FILTER (WHERE n.cluster <> c.cluster) AS n_misplaced
        FROM clustered c JOIN members{KMEANS_STEPS + 1} n USING (Tag)""",
    "kmeans_sizes": CLUSTER_SIZES,
    "kmeans_sizes_export": CLUSTER_SIZES,
    "cluster_word_freq": CLUSTER_WORDS,
    "cluster_word_freq_export": CLUSTER_WORDS,
    "tag_levenshtein": """SELECT a.Tag AS a, b.Tag AS b, CAST(levenshtein(a.Tag, b.Tag) AS INT) AS distance
        FROM frequency a JOIN frequency b ON a.Tag < b.Tag WHERE levenshtein(a.Tag, b.Tag) <= 2""",
}


def _needed(sql: str, found: list[str]) -> list[str]:
    """Views that a statement reads, each after the views it reads itself."""
    for name in VIEWS:
        if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            _needed(VIEWS[name], found)
            if name not in found:
                found.append(name)
    return found


def statement(name: str) -> str:
    body = QUERIES[name]
    views = [f"{view} AS MATERIALIZED ({VIEWS[view]})" for view in _needed(body, [])]
    return f"WITH {', '.join(views)} {body}" if views else body


def statements() -> dict[str, str]:
    return {name: statement(name) for name in QUERIES}
