"""Independent SQL for the registered queries, in DuckDB's dialect.

Written against the provided tables only. Metrics use one plain window over all
scores, samples compare hash bits as numbers and components spread labels by
recursion, so none of them shares its method with the Spark side.
"""

from __future__ import annotations

from feedlens import schema as S
from feedlens.verify import queries as Q

#: The stand-in interaction table.
INTERACTIONS = r"""
interactions AS (
  SELECT text_tokens, hashtags, tweet_id, present_media, present_links, present_domains, tweet_type, language, tweet_timestamp,
         engaged_with_user_id, engaged_with_user_follower_count, engaged_with_user_following_count,
         engaged_with_user_is_verified, engaged_with_user_account_creation,
         engaging_user_id, engaging_user_follower_count, engaging_user_following_count,
         engaging_user_is_verified, engaging_user_account_creation, engagee_follows_engager,
         CASE WHEN k % 29 = 0 THEN tweet_timestamp + 60 + k % 7200 END AS reply_timestamp,
         CASE WHEN k % 11 = 0 THEN tweet_timestamp + 120 + k % 7200 END AS retweet_timestamp,
         CASE WHEN k % 97 = 0 THEN tweet_timestamp + 180 + k % 7200 END AS retweet_with_comment_timestamp,
         CASE WHEN k % 5 < 2 THEN tweet_timestamp + 30 + k % 7200 END AS like_timestamp
  FROM (
    SELECT concat('101', chr(9), cast(o.o_orderkey % 1000 AS varchar), chr(9), '102') AS text_tokens,
           CASE WHEN o.o_orderkey % 3 = 0 THEN concat('h', cast(o.o_orderkey % 50 AS varchar), chr(9), 'h', cast(o.o_orderkey % 7 AS varchar)) END AS hashtags,
           concat('t', cast(o.o_orderkey AS varchar)) AS tweet_id,
           CASE WHEN o.o_orderkey % 4 = 1 THEN 'Photo' WHEN o.o_orderkey % 4 = 2 THEN concat('Photo', chr(9), 'Video') END AS present_media,
           CASE WHEN o.o_orderkey % 10 = 0 THEN concat('l', cast(o.o_orderkey % 90 AS varchar)) END AS present_links,
           CASE WHEN o.o_orderkey % 10 = 0 THEN concat('d', cast(o.o_orderkey % 9 AS varchar)) END AS present_domains,
           CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'Retweet' WHEN '2' THEN 'Quote' WHEN '3' THEN 'Reply' ELSE 'Toplevel' END AS tweet_type,
           concat('lang', cast(o.o_orderkey % 4 AS varchar)) AS language,
           cast(epoch(o.o_orderdate) AS bigint) + (o.o_orderkey * 37) % 86400 AS tweet_timestamp,
           concat('u', cast(a.c_custkey AS varchar)) AS engaged_with_user_id,
           cast(floor(a.c_acctbal) AS bigint) + 1000 AS engaged_with_user_follower_count,
           cast(a.c_custkey % 500 AS bigint) AS engaged_with_user_following_count,
           a.c_mktsegment = 'BUILDING' AS engaged_with_user_is_verified,
           cast(1200000000 + a.c_custkey * 86400 AS bigint) AS engaged_with_user_account_creation,
           concat('u', cast(e.p_partkey AS varchar)) AS engaging_user_id,
           cast(floor(e.p_retailprice) AS bigint) AS engaging_user_follower_count,
           cast(e.p_size * 10 AS bigint) AS engaging_user_following_count,
           e.p_brand = 'Brand#11' AS engaging_user_is_verified,
           cast(1200000000 + e.p_partkey * 86400 AS bigint) AS engaging_user_account_creation,
           (a.c_custkey + e.p_partkey) % 3 = 0 AS engagee_follows_engager,
           o.o_orderkey * 31 + e.p_partkey * 17 AS k
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer a ON a.c_custkey = o.o_custkey
    JOIN part e ON e.p_partkey = l.l_partkey
  )
)"""

KEYS = "tweet_id, engaging_user_id"
ALL = ", ".join(S.ALL_COLUMNS)
FEATURES = ", ".join(S.MODEL_FEATURES)
LABELS = ", ".join(S.LABELS)
ENGAGED = " OR ".join(f"{c} IS NOT NULL" for c in S.LABELS)
TARGETS = ", ".join(f"{c} IS NOT NULL AS {t}" for t, c in S.TARGETS.items())
SCORE = (
    "round(1 / (1 + exp(-(-1.0 + 0.1 * ln(1 + engaging_user_follower_count)"
    " - 0.05 * ln(1 + engaged_with_user_follower_count)))), 6)"
)


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([INTERACTIONS, *ctes]) + "\n" + body


def labels_as_rows(select: str, names: dict[str, object]) -> str:
    """One branch per label; ``{ts}`` and ``{type}`` stand for its values."""
    return " UNION ALL ".join(
        f"SELECT {select.format(ts=c, type=repr(v))} FROM interactions WHERE {c} IS NOT NULL" for c, v in names.items()
    )


EVENTS = f"events AS ({labels_as_rows('{ts} AS timestamp, {type} AS type', S.SHORT_TYPES)})"
HOURLY = """hourly AS (
  SELECT strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%d-%H') AS date, type, count(*) AS count
  FROM events GROUP BY 1, 2)"""
EDGE_COLUMNS = "dst_follows_src, text_tokens, hashtags, tweet_id, present_media, present_links, present_domains, tweet_type, language, tweet_timestamp"
EDGES = "edges AS ({})".format(
    labels_as_rows(
        "engaging_user_id AS src, engaged_with_user_id AS dst, engagee_follows_engager AS " + EDGE_COLUMNS
        + ", {ts} AS interaction_timestamp, cast({type} AS integer) AS interaction_type",
        S.EDGE_TYPES,
    )
)
USER = ", ".join(f"{{role}}_user_{c} AS {c}" for c in ("id", "follower_count", "following_count", "is_verified", "account_creation"))
VERTICES = (
    f"vertices AS (SELECT {USER.format(role='engaged_with')} FROM interactions WHERE {ENGAGED}"
    f" UNION SELECT {USER.format(role='engaging')} FROM interactions WHERE {ENGAGED})"
)
IN_DEGREES = "in_degrees AS (SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY 1)"
#: Degrees of both users without the edges of the row itself.
OWN_EDGES = " + ".join(f"cast({c} IS NOT NULL AS bigint)" for c in S.LABELS)
OTHER_DEGREES = ", ".join(
    f"coalesce({d}, 0) - ({OWN_EDGES}) AS {user}_user_{d}" for d, user in (("in_degree", "engaged_with"), ("out_degree", "engaging"))
)
OUT_DEGREES = "out_degrees AS (SELECT src AS id, count(*) AS out_degree FROM edges GROUP BY 1)"

LONG = "long AS ({})".format(
    " UNION ALL ".join(
        f"SELECT *, '{t}' AS target, cast({c} IS NOT NULL AS integer) AS y, {SCORE} AS p FROM interactions"
        for t, c in S.TARGETS.items()
    )
)


def evaluation(source: str, by: str) -> str:
    """CTEs that end in ``evaluated(by…, ap, rce)``."""
    return f"""
scores AS (SELECT {by}, p, sum(y) AS pos, count(*) AS n FROM {source} GROUP BY {by}, p),
thresholds AS (SELECT *, sum(pos) OVER w / sum(n) OVER w AS prec FROM scores
  WINDOW w AS (PARTITION BY {by} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
ranked AS (SELECT {by}, CASE WHEN sum(pos) > 0 THEN sum(pos * prec) / sum(pos) END AS ap FROM thresholds GROUP BY {by}),
loss AS (SELECT {by}, avg(y) AS r,
    avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))) AS ce
  FROM {source} GROUP BY {by}),
evaluated AS (SELECT {by}, ap, ce, r,
    CASE WHEN r > 0 AND r < 1 THEN (1 - ce / -(r * ln(r) + (1 - r) * ln(1 - r))) * 100 END AS rce
  FROM ranked JOIN loss USING ({by}))"""


def drawn(fraction: str, seed: str) -> str:
    """Key-hash draw: 32 leading bits of the digest below the fraction."""
    bits = f"cast(concat('0x', substr(md5(concat_ws('|', tweet_id, engaging_user_id, {seed})), 1, 8)) AS bigint)"
    return f"{bits} < ({fraction}) * 4294967296.0"


def fold_ctes(plan) -> str:
    def fraction(rows: int, count: str) -> str:
        return f"least(1.0, {rows} / cast({count} AS double))"

    seed = "cast({} + f.fold AS varchar)".format
    columns = ", ".join(f"i.{c}" for c in S.ALL_COLUMNS)
    train = drawn(fraction(plan.train_rows, "(SELECT n_train FROM totals)"), seed(plan.train_seed + plan.seed))
    known = drawn(fraction(plan.test_rows, "f.n"), seed(plan.test_seed + plan.seed))
    extra = drawn(fraction(plan.extra_rows, "(SELECT n_test FROM totals)"), seed(plan.extra_seed + plan.seed))
    return f"""
folds AS (SELECT cast(unnest(range({plan.folds})) AS integer) AS fold),
totals AS (SELECT count(*) FILTER (tweet_timestamp < {plan.split}) AS n_train,
                  count(*) FILTER (tweet_timestamp > {plan.split}) AS n_test FROM interactions),
train AS (SELECT f.fold, {columns} FROM interactions i, folds f WHERE tweet_timestamp < {plan.split} AND {train}),
users AS (SELECT DISTINCT fold, engaging_user_id AS u FROM train),
eligible AS (SELECT users.fold, i.* FROM interactions i JOIN users ON users.u = i.engaging_user_id
  WHERE tweet_timestamp > {plan.split}),
sizes AS (SELECT fold, count(*) AS n FROM eligible GROUP BY 1),
test AS (
  SELECT i.fold, {columns} FROM eligible i JOIN sizes f ON f.fold = i.fold WHERE {known}
  UNION
  SELECT f.fold, {columns} FROM interactions i, folds f WHERE tweet_timestamp > {plan.split} AND {extra}),
fold_long AS ({" UNION ALL ".join(
    f"SELECT fold, '{s}' AS split, '{t}' AS target, cast({c} IS NOT NULL AS integer) AS y, {SCORE} AS p FROM {s}"
    for s in ("train", "test") for t, c in S.TARGETS.items())})"""


FOLDS = fold_ctes(Q.PLAN)
FOLD_EVALUATION = (FOLDS, evaluation("fold_long", "fold, split, target"))


def component_ctes(links: str, vertices: str) -> list[str]:
    """Minimum label propagation over ``links(a, b)``, both directions given."""
    return [
        f"links AS ({links})",
        f"ids AS (SELECT DISTINCT id FROM ({vertices}))",
        """labels(id, component) USING KEY (id) AS (
  SELECT id, id FROM ids
  UNION
  SELECT l.a, min(c.component) FROM links l JOIN labels c ON c.id = l.b JOIN recurring.labels k ON k.id = l.a
  GROUP BY l.a HAVING min(c.component) < min(k.component))""",
    ]


COMPONENTS = component_ctes(
    "SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT DISTINCT dst, src FROM edges", "SELECT id FROM vertices"
)
TYPED = "typed AS (SELECT concat(interaction_type, ':', src) AS src, concat(interaction_type, ':', dst) AS dst FROM edges)"
TYPED_COMPONENTS = component_ctes(
    "SELECT src AS a, dst AS b FROM typed UNION SELECT dst, src FROM typed", "SELECT src AS id FROM typed UNION SELECT dst FROM typed"
)


def whole_list(name: str, cast: str = "") -> str:
    items = f"string_split({name}, chr(9))"
    return (
        f"cast(len({items}) AS integer) AS {name}_size, {items}[1]{cast} AS {name}_first, replace({name}, chr(9), '|') AS {name}_items"
    )


def summary(metric: str) -> str:
    return (
        f"round(avg({metric}), 6) AS {metric}_mean, round(stddev_pop({metric}), 6) AS {metric}_sigma, "
        f"round(avg({metric}) - stddev_pop({metric}), 6) AS {metric}_lb, round(avg({metric}) + stddev_pop({metric}), 6) AS {metric}_ub"
    )


def statistics(rows: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS statistic, round(cast(({v}) AS double), 6) AS value" for k, v in rows.items())


#: 32-bit view of the table, as stored samples have it.
INT_COLUMNS = ", ".join(
    f"cast({c} AS integer) AS {c}" if S.SAMPLE_TYPES[c].typeName() == "integer" else c for c in S.ALL_COLUMNS
)
TEXT_COLUMNS = ", ".join(f"cast({c} AS varchar) AS {c}" for c in S.ALL_COLUMNS)
SAMPLE_COLUMNS = ", ".join(
    "'0' AS hashtags" if c == "hashtags"
    else "false AS engaging_user_is_verified" if c == "engaging_user_is_verified"
    else f"cast({c} IS NOT NULL AS integer) AS {c}" if c in S.LABELS
    else f"cast({c} AS integer) AS {c}" if S.SAMPLE_TYPES[c].typeName() == "integer"
    else c
    for c in S.ALL_COLUMNS
)
PERCENT = ", ".join(f"round(count({c}) / count(*) * 100, 6) AS {t}_pct" for t, c in S.TARGETS.items())

ORACLES: dict[str, str] = {
    # profile and projections
    "engagement_profile": sql(
        f"SELECT count(*) AS rows, round(count(hashtags) / count(*) * 100, 6) AS with_hashtags_pct, "
        f"round(count(*) FILTER (NOT ({ENGAGED})) / count(*) * 100, 6) AS negative_pct, {PERCENT} FROM interactions"
    ),
    "row_count": sql("SELECT count(*) AS n FROM interactions"),
    "binarize_targets": sql(f"SELECT {KEYS}, {TARGETS} FROM interactions"),
    "timestamp_to_flag": sql(
        f"SELECT {KEYS}, " + ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END AS {c}" for c in S.LABELS) + " FROM interactions"
    ),
    "zero_fill_columns": sql(
        f"SELECT {KEYS}, '0' AS hashtags, false AS engaged_with_user_is_verified, "
        "cast(0 AS bigint) AS engaged_with_user_follower_count FROM interactions"
    ),
    "engaged_with_users": sql(f"SELECT {USER.format(role='engaged_with')} FROM interactions"),
    "engaging_users": sql(f"SELECT {USER.format(role='engaging')} FROM interactions"),
    # sources and sinks
    "csv_roundtrip": sql(f"SELECT {ALL} FROM interactions"),
    "unlabelled_scan": sql(f"SELECT {', '.join(S.INPUT_COLUMNS)} FROM interactions"),
    "part_files": sql(f"SELECT {KEYS}, {FEATURES} FROM interactions"),
    "parquet_projection": sql(f"SELECT {KEYS}, language, tweet_type, like_timestamp FROM interactions"),
    "raw_lines_split": sql(f"SELECT {TEXT_COLUMNS} FROM interactions"),
    "typed_cast": sql(f"SELECT {INT_COLUMNS} FROM interactions"),
    "list_columns": sql(
        f"SELECT {KEYS}, {whole_list('text_tokens', '::bigint')}, "
        + ", ".join(whole_list(c) for c in S.LIST_FIELDS if c != "text_tokens")
        + " FROM interactions"
    ),
    "predictions_export": sql(
        f"SELECT {KEYS}, " + ", ".join(f"{SCORE} AS {t}" for t in S.TARGET_NAMES) + " FROM interactions"
    ),
    # filters
    "with_hashtags": sql(f"SELECT {KEYS}, hashtags FROM interactions WHERE length(hashtags) > 0"),
    "negatives": sql(f"SELECT {KEYS}, tweet_timestamp FROM interactions WHERE coalesce({LABELS}) IS NULL"),
    "positives": sql(f"SELECT {KEYS}, {LABELS} FROM interactions WHERE coalesce({LABELS}) IS NOT NULL"),
    "engaged_like": sql(f"SELECT {KEYS}, like_timestamp FROM interactions WHERE like_timestamp IS NOT NULL"),
    "by_engagement": sql(
        " UNION ALL ".join(f"SELECT '{t}' AS target, {KEYS} FROM interactions WHERE {c} IS NOT NULL" for t, c in S.TARGETS.items())
    ),
    "time_window": sql(
        f"SELECT {KEYS}, tweet_timestamp FROM interactions "
        f"WHERE tweet_timestamp > (SELECT max(tweet_timestamp) FROM interactions) - {Q.WINDOW}"
    ),
    "time_split": sql(
        f"SELECT {KEYS}, tweet_timestamp, 'train' AS side FROM interactions WHERE tweet_timestamp < {Q.SPLIT} UNION ALL "
        f"SELECT {KEYS}, tweet_timestamp, 'test' FROM interactions WHERE tweet_timestamp > {Q.SPLIT}"
    ),
    # hourly series
    "interaction_long": sql("SELECT timestamp, type FROM events", EVENTS),
    "hourly_counts": sql("SELECT * FROM hourly ORDER BY type, date", EVENTS, HOURLY),
    "full_hour_counts": sql(
        "SELECT cast(epoch(date_trunc('hour', to_timestamp(timestamp) AT TIME ZONE 'UTC')) AS bigint) AS hour, type, "
        "count(*) AS count FROM events GROUP BY 1, 2",
        EVENTS,
    ),
    "hourly_pivot": sql(
        "SELECT date, " + ", ".join(f"cast(sum(count) FILTER (type = '{t}') AS bigint) AS {t}" for t in S.SHORT_TYPES.values())
        + " FROM hourly GROUP BY date",
        EVENTS,
        HOURLY,
    ),
    "hourly_grid_complete": sql(
        f"SELECT count(*) AS groups, cast({Q.DAYS * 24 * 4} AS integer) AS expected, count(*) = {Q.DAYS * 24 * 4} AS complete FROM hourly",
        EVENTS,
        HOURLY,
    ),
    "top_hours": sql("SELECT * FROM hourly ORDER BY count DESC, date, type LIMIT 10", EVENTS, HOURLY),
    # metrics
    "log_loss": sql(
        "SELECT target, round(r, 6) AS ctr, round(ce, 6) AS log_loss FROM evaluated", LONG, evaluation("long", "target")
    ),
    "click_rate": sql("SELECT target, round(avg(y), 6) AS ctr FROM long GROUP BY 1", LONG),
    "rce": sql("SELECT target, round(rce, 6) AS rce FROM evaluated", LONG, evaluation("long", "target")),
    "average_precision": sql("SELECT target, round(ap, 6) AS ap FROM evaluated", LONG, evaluation("long", "target")),
    "average_precision_by_language": sql(
        "SELECT language, target, round(ap, 6) AS ap FROM evaluated", LONG, evaluation("long", "language, target")
    ),
    "predictions_joined": sql(
        f"SELECT {KEYS}, " + ", ".join(f"{SCORE} AS predicted_{t}, cast({c} IS NOT NULL AS integer) AS {t}" for t, c in S.TARGETS.items())
        + " FROM interactions"
    ),
    "evaluate_all": sql(
        "SELECT target, round(ap, 6) AS ap, round(rce, 6) AS rce FROM evaluated", LONG, evaluation("long", "target")
    ),
    "fold_metrics": sql("SELECT fold, split, target, round(ap, 6) AS ap, round(rce, 6) AS rce FROM evaluated", *FOLD_EVALUATION),
    "fold_summary": sql(
        f"SELECT split, target, {summary('ap')}, {summary('rce')} FROM evaluated GROUP BY 1, 2", *FOLD_EVALUATION
    ),
    "mean_metrics": sql(
        "SELECT split, round(avg(ap), 6) AS map_mean, round(stddev_pop(ap), 6) AS map_sigma, "
        "round(avg(rce), 6) AS mrce_mean, round(stddev_pop(rce), 6) AS mrce_sigma FROM evaluated GROUP BY 1",
        *FOLD_EVALUATION,
    ),
    "score_map_in_pandas": sql(f"SELECT {KEYS}, {SCORE} AS p FROM interactions"),
    # samples, folds, splits
    "hash_sample": sql(f"SELECT {KEYS}, tweet_timestamp FROM interactions WHERE " + drawn("0.1", "'42'")),
    "fold_train": sql(f"SELECT fold, {KEYS}, tweet_timestamp FROM train", FOLDS),
    "fold_test": sql(f"SELECT fold, {ALL} FROM test", FOLDS),
    "sample_users": sql(
        f"SELECT DISTINCT engaging_user_id FROM interactions WHERE tweet_timestamp < {Q.SPLIT} AND " + drawn("0.1", "'42'")
    ),
    "sample_generator": sql(
        f"SELECT {SAMPLE_COLUMNS} FROM interactions WHERE "
        + drawn(f"least(1.0, {Q.SAMPLE.rows} / cast((SELECT count(*) FROM interactions) AS double))", "'42'")
    ),
    "sample_generator_window": sql(
        f"SELECT {KEYS}, " + ", ".join(f"cast({c} AS integer) AS {c}" for c in ["tweet_timestamp", *S.LABELS])
        + f" FROM interactions WHERE tweet_timestamp > (SELECT max(tweet_timestamp) FROM interactions) - {Q.WINDOW}"
    ),
    "positional_split": sql(
        f"SELECT {KEYS}, {FEATURES}, retweet_with_comment, part FROM (SELECT *, "
        "CASE WHEN i < floor(0.6 * n) THEN 'train' WHEN i >= floor(0.8 * n) THEN 'test' END AS part FROM ("
        f"SELECT *, retweet_with_comment_timestamp IS NOT NULL AS retweet_with_comment, "
        f"row_number() OVER (ORDER BY {KEYS}) - 1 AS i, count(*) OVER () AS n FROM interactions)) WHERE part IS NOT NULL"
    ),
    "exact_sample": sql(
        f"SELECT {KEYS}, tweet_timestamp FROM interactions ORDER BY md5(concat_ws('|', {KEYS}, '42')) LIMIT 4000"
    ),
    "sorted_dataset_order": sql("SELECT count(*) AS rows, true AS sorted_inside, true AS sorted_across FROM interactions"),
    "validated_fit": sql(
        " UNION ALL ".join(
            f"SELECT '{t}' AS target, true AS within_limit, true AS last_is_best FROM interactions "
            f"WHERE tweet_timestamp < {Q.SPLIT} HAVING count({c}) BETWEEN 1 AND count(*) - 1"
            for t, c in S.TARGETS.items()
        )
    ),
    "sorted_dataset": sql(f"SELECT {KEYS}, {FEATURES} FROM interactions ORDER BY {KEYS}"),
    # graph
    "graph_vertices": sql("SELECT * FROM vertices", VERTICES),
    "latest_vertices": sql(
        "SELECT id, follower_count, following_count, is_verified, account_creation FROM (SELECT *, row_number() OVER "
        "(PARTITION BY id ORDER BY t DESC, follower_count DESC, following_count DESC, is_verified DESC, account_creation DESC) AS i FROM ("
        + " UNION ALL ".join(
            f"SELECT {USER.format(role=r)}, tweet_timestamp AS t FROM interactions WHERE {ENGAGED}" for r in ("engaged_with", "engaging")
        )
        + ")) WHERE i = 1"
    ),
    "graph_edges": sql("SELECT * FROM edges", EDGES),
    "graph_sizes": sql(
        "SELECT (SELECT count(*) FROM vertices) AS n_vertices, (SELECT count(*) FROM edges) AS n_edges", VERTICES, EDGES
    ),
    "in_degrees": sql("SELECT * FROM in_degrees", EDGES, IN_DEGREES),
    "out_degrees": sql("SELECT * FROM out_degrees", EDGES, OUT_DEGREES),
    "degree_summary": sql(
        " UNION ALL ".join(
            f"SELECT '{d}' AS direction, max({d}) AS max, min({d}) AS min, round(avg({d}), 6) AS avg, "
            f"round(stddev_samp({d}), 6) AS stddev FROM {d}s"
            for d in ("in_degree", "out_degree")
        ),
        EDGES, IN_DEGREES, OUT_DEGREES,
    ),
    "drop_isolated": sql(
        "SELECT v.* FROM vertices v WHERE EXISTS (SELECT 1 FROM edges e WHERE e.interaction_type = 3 AND e.src = v.id) "
        "OR EXISTS (SELECT 1 FROM edges e WHERE e.interaction_type = 3 AND e.dst = v.id)",
        VERTICES, EDGES,
    ),
    "components": sql(
        "SELECT v.*, component FROM vertices v JOIN labels USING (id)", VERTICES, EDGES, *COMPONENTS, recursive=True
    ),
    "components_by_type": sql("SELECT id, component FROM labels", EDGES, TYPED, *TYPED_COMPONENTS, recursive=True),
    "component_stats": sql(
        "SELECT count(DISTINCT component) AS n_components, round(count(*) / count(DISTINCT component), 6) AS avg_vertices FROM labels",
        EDGES, TYPED, *TYPED_COMPONENTS, recursive=True,
    ),
    "degrees_without_own_row": sql(
        f"SELECT {KEYS}, {OTHER_DEGREES} FROM interactions "
        "LEFT JOIN in_degrees i ON i.id = engaged_with_user_id LEFT JOIN out_degrees o ON o.id = engaging_user_id",
        EDGES, IN_DEGREES, OUT_DEGREES,
    ),
    "degrees_as_of": sql(
        f"SELECT {KEYS}, coalesce(i.c, 0) AS engaged_with_user_in_degree, coalesce(o.c, 0) AS engaging_user_out_degree FROM interactions r "
        "ASOF LEFT JOIN i ON i.id = r.engaged_with_user_id AND i.t < r.tweet_timestamp "
        "ASOF LEFT JOIN o ON o.id = r.engaging_user_id AND o.t < r.tweet_timestamp",
        EDGES,
        *[
            f"{name} AS (SELECT {end} AS id, greatest(interaction_timestamp, tweet_timestamp) AS t, "
            f"cast(sum(count(*)) OVER (PARTITION BY {end} ORDER BY greatest(interaction_timestamp, tweet_timestamp)) AS bigint) AS c FROM edges GROUP BY 1, 2)"
            for name, end in (("i", "dst"), ("o", "src"))
        ],
    ),
    "degree_features": sql(
        f"SELECT {KEYS}, coalesce(i.in_degree, 0) AS engaged_with_user_in_degree, coalesce(o.out_degree, 0) AS engaging_user_out_degree "
        "FROM interactions LEFT JOIN in_degrees i ON i.id = engaged_with_user_id LEFT JOIN out_degrees o ON o.id = engaging_user_id",
        EDGES, IN_DEGREES, OUT_DEGREES,
    ),
    "graph_report": sql(
        statistics(
            {
                "n_vertices": "SELECT count(*) FROM vertices",
                "n_edges": "SELECT count(*) FROM edges",
                "n_not_isolated": "SELECT count(*) FROM vertices WHERE id IN (SELECT src FROM edges UNION SELECT dst FROM edges)",
                **{
                    f"{d}_{name}": f"SELECT {f}({d}) FROM {d}s"
                    for d in ("in_degree", "out_degree")
                    for name, f in (("max", "max"), ("min", "min"), ("avg", "avg"), ("stddev", "stddev_samp"))
                },
                "n_components": "SELECT count(DISTINCT component) FROM labels",
                "avg_vertices": "SELECT count(*) / count(DISTINCT component) FROM labels JOIN vertices USING (id)",
            }
        ),
        VERTICES, EDGES, IN_DEGREES, OUT_DEGREES, *COMPONENTS, recursive=True,
    ),
    # feature store
    "feature_assembly": sql(
        f"SELECT {KEYS}, {FEATURES}, {TARGETS}, {OTHER_DEGREES} FROM interactions "
        "LEFT JOIN in_degrees i ON i.id = engaged_with_user_id LEFT JOIN out_degrees o ON o.id = engaging_user_id",
        EDGES, IN_DEGREES, OUT_DEGREES,
    ),
    "feature_concat": sql(
        f"SELECT {KEYS}, {TARGETS}, " + ", ".join(f"{c} - tweet_timestamp AS {t}_delay" for t, c in S.TARGETS.items()) + " FROM interactions"
    ),
    "auxiliary_extend": sql(f"SELECT * FROM edges WHERE tweet_timestamp <> {Q.SPLIT}", EDGES),
    "auxiliary_degrees": sql(
        "SELECT id, cast(sum(i) AS bigint) AS in_degree, cast(sum(o) AS bigint) AS out_degree FROM ("
        f"SELECT dst AS id, 1 AS i, 0 AS o FROM edges WHERE tweet_timestamp <> {Q.SPLIT} UNION ALL "
        f"SELECT src, 0, 1 FROM edges WHERE tweet_timestamp <> {Q.SPLIT}) GROUP BY 1",
        EDGES,
    ),
    "row_contract_check": sql(
        "SELECT count(*) AS raw_rows, count(*) AS feature_rows, "
        f"cast(count(*) - count(DISTINCT ({KEYS})) AS bigint) AS surplus_rows, "
        "cast(0 AS bigint) AS missing_keys, cast(0 AS bigint) AS foreign_keys, "
        f"count(*) = count(DISTINCT ({KEYS})) AS holds FROM interactions"
    ),
    "row_contract_foreign": sql(
        "SELECT count(*) AS raw_rows, count(*) AS feature_rows, cast(count(*) - count(DISTINCT ({0})) AS bigint) AS surplus_rows, "
        "count(DISTINCT ({0})) FILTER (tweet_timestamp >= {1}) AS missing_keys, count(DISTINCT ({0})) FILTER (tweet_timestamp >= {1}) AS foreign_keys, "
        "false AS holds FROM interactions".format(KEYS, Q.SPLIT)
    ),
    "published_predictions": sql(f"SELECT {KEYS}, " + ", ".join(f"{SCORE} AS {t}" for t in S.TARGET_NAMES) + " FROM interactions"),
    # streaming
    "stream_hourly": sql(
        "SELECT timestamp // 3600 * 3600 AS hour, type, count(*) AS count FROM events GROUP BY 1, 2",
        EVENTS,
    ),
    "stream_hourly_late": sql(
        "SELECT timestamp // 3600 * 3600 AS hour, type, count(*) AS count FROM events GROUP BY 1, 2",
        EVENTS,
    ),
    "stream_scored_model": sql("SELECT count(*) AS n_streamed, CAST(0 AS BIGINT) AS n_different FROM interactions"),
    "stream_scored": sql(f"SELECT {KEYS}, {SCORE} AS p FROM interactions"),
}
