"""Queries of operators that work on rows, sets of keys and samples; they join the catalogue's dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderloom.functions import scalars as fn
from cinderloom.operators import bookkeeping, ledger, materialize, predictions, selection, validation
from cinderloom.plans import bindings as v
from cinderloom.plans.catalogue import query, r6

# Scalar functions.

_MIXED = "CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS {t}) || '.75' WHEN 1 THEN 'yes' WHEN 2 THEN '' WHEN 3 THEN ' -' || CAST(o_orderkey AS {t}) || '.5 ' WHEN 4 THEN ' TRUE ' ELSE CASE WHEN o_orderstatus = 'O' THEN '1' ELSE NULL END END"


@query(f"""SELECT o_orderkey, TRY_CAST(m AS DOUBLE) AS number, CAST(trunc(TRY_CAST(m AS DOUBLE)) AS BIGINT) AS whole, coalesce(lower(trim(m)) IN ('1', 'true', 'yes', 'y'), false) AS truthy
FROM (SELECT o_orderkey, {_MIXED.format(t="VARCHAR")} AS m FROM orders) t""")
def lenient_values(spark, sf_dir):
    rows = v.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_MIXED.format(t="STRING")).alias("m"))
    m = F.col("m")
    return rows.select("o_orderkey", fn.lenient_double(m).alias("number"), fn.lenient_long(m).alias("whole"), fn.truthy(m).alias("truthy"))


@query("""SELECT vec_id, round(exp(list_sum(list_transform(embedding, lambda x: ln(greatest(abs(CAST(x AS DOUBLE)), 1e-12)))) / len(embedding)), 6) AS confidence FROM embeddings""")
def sequence_confidence(spark, sf_dir):
    steps = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return v.table(spark, sf_dir, "embeddings").select("vec_id", F.round(fn.sequence_confidence(steps), 6).alias("confidence"))


@query("""SELECT run_id, round(exp(avg(metric)), 6) AS perplexity FROM v_cycles GROUP BY run_id""")
def perplexity(spark, sf_dir):
    return v.cycles(spark, sf_dir).groupBy("run_id").agg(F.avg("metric").alias("loss")).select("run_id", F.round(fn.perplexity(F.col("loss")), 6).alias("perplexity"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(' ' || p_name || ' / ' || p_type || '!', '[^A-Za-z0-9]+', '_', 'g'), '_')) AS slug FROM part""")
def slugs(spark, sf_dir):
    name = F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_type", F.lit("!"))
    return v.table(spark, sf_dir, "part").select("p_partkey", fn.slug(name).alias("slug"))


@query("""SELECT attempt_id, run_id || ':c' || cycle || ':d' || (attempt_id % 5) AS decision_id, run_id || ':c' || cycle || ':a' || attempt_id AS attempt_name FROM v_attempts""")
def decision_ids(spark, sf_dir):
    run, cycle = F.col("run_id"), F.col("cycle")
    return v.attempts(spark, sf_dir).select("attempt_id", fn.decision_id(run, cycle, F.col("attempt_id") % 5).alias("decision_id"), fn.decision_id(run, cycle, F.col("attempt_id"), "a").alias("attempt_name"))


@query("""SELECT run_id, array_to_string(list_filter(list_transform(string_split(policy || ' ,, ' || control || ',' || subset || ' ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS options FROM v_runs""")
def option_split(spark, sf_dir):
    text = F.concat("policy", F.lit(" ,, "), "control", F.lit(","), "subset", F.lit(" "))
    return v.runs(spark, sf_dir).select("run_id", F.array_join(fn.option_values(text), "|").alias("options"))


_REPLY = """CASE attempt_id % 5 WHEN 0 THEN '{{"class_label": ' || CAST(cycle AS {t}) || '}}' WHEN 1 THEN 'so "class_label" : ' || CAST(cycle AS {t}) || ', of 9' WHEN 2 THEN 'the answer is ' || CAST(cycle + 2 AS {t}) || ' or 1' WHEN 3 THEN 'none of these' ELSE '{{"class_label": "-1"}}' END"""


@query(f"""SELECT attempt_id, CASE WHEN found BETWEEN 0 AND 4 THEN found END AS class_label FROM (SELECT attempt_id, coalesce(CASE WHEN json_valid(reply) THEN TRY_CAST(json_extract_string(reply, '$.class_label') AS INTEGER) END,
  TRY_CAST(nullif(regexp_extract(reply, '"class_label"\\s*:\\s*(-?[0-9]+)', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(reply, '(-?[0-9]+)', 1), '') AS INTEGER)) AS found
FROM (SELECT attempt_id, {_REPLY.format(t="VARCHAR")} AS reply FROM v_attempts ) r) f""")
def reply_labels(spark, sf_dir):
    rows = v.attempts(spark, sf_dir).select("attempt_id", F.expr(_REPLY.format(t="STRING")).alias("reply"))
    return rows.select("attempt_id", fn.label_from_reply(F.col("reply"), 5).alias("class_label"))


@query("""SELECT run_id, CASE policy WHEN '1-URGENT' THEN 'strong' WHEN '2-HIGH' THEN 'strong' WHEN '5-LOW' THEN 'cheap' ELSE 'other' END AS tier FROM v_runs""")
def label_map_lookup(spark, sf_dir):
    tiers = {"1-URGENT": "strong", "2-HIGH": "strong", "5-LOW": "cheap"}
    return v.runs(spark, sf_dir).select("run_id", fn.looked_up(F.col("policy"), tiers, "other").alias("tier"))


@query("""SELECT vec_id, array_to_string(list_transform(range(1, 8), lambda i: CASE WHEN w[i] IS NULL OR (i > 1 AND w[i - 1] IS NOT DISTINCT FROM w[i]) THEN -100 ELSE l[w[i] + 1] END), ',') AS aligned
FROM (SELECT vec_id, [NULL, 0, 0, 1, CAST(1 + vec_id % 2 AS INTEGER), 2, NULL] AS w, [label, label + 1, label + 2] AS l FROM embeddings) t""")
def subword_labels(spark, sf_dir):
    none = F.lit(None).cast("int")
    words = F.array(none, F.lit(0), F.lit(0), F.lit(1), (1 + F.col("vec_id") % 2).cast("int"), F.lit(2), none)
    return v.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(fn.aligned_labels(words, F.array("label", F.col("label") + 1, F.col("label") + 2)), ",").alias("aligned"))


# Predicates and projections.


@query("""SELECT run_id, coalesce(control IN ('F', '5-LOW'), false) OR coalesce(policy IN ('F', '5-LOW'), false) AS is_control, run_id % 2 = 0 AND NOT (coalesce(control IN ('F', '5-LOW'), false) OR coalesce(policy IN ('F', '5-LOW'), false)) AS is_fixed FROM v_runs""")
def run_kinds(spark, sf_dir):
    names = ["F", "5-LOW", "fixed_5-LOW"]
    policy = F.when(F.col("run_id") % 2 == 0, F.concat(F.lit("fixed_"), "policy")).otherwise(F.col("policy"))
    return v.runs(spark, sf_dir).select("run_id", validation.is_control(F.col("control"), policy, names).alias("is_control"), validation.is_fixed(policy, F.col("control"), names).alias("is_fixed"))


@query("""SELECT id, label FROM v_train WHERE label IN ('en', 'de') AND (source_split = 'train' OR label = 'en')""")
def label_validity(spark, sf_dir):
    reply = F.concat(F.lit(" "), F.upper("label"), F.lit(". "))
    rows = v.train(spark, sf_dir).withColumn("reply", reply).withColumn("gold", F.when(F.col("source_split") == "train", F.col("label")).otherwise("EN"))
    return validation.valid_labels(rows, "reply", ["en", "de"], "gold").select("id", "label")


@query("""SELECT attempt_id FROM v_attempts WHERE ledger IS NULL OR ledger < coalesce(predicted, 0) + coalesce(provider, 0)""")
def token_field_errors(spark, sf_dir):
    return validation.bad_usage(v.attempts(spark, sf_dir), "predicted", "provider", "ledger").select("attempt_id")


@query("""SELECT attempt_id, CASE WHEN status = 'budget_violation' THEN 'invalid_label' WHEN status = 'failed' OR (provider IS NULL AND cycle = 0) THEN 'parse_failure' END AS failure FROM v_attempts""")
def attempt_failures(spark, sf_dir):
    a = v.attempts(spark, sf_dir)
    error = F.when(F.col("status") == "budget_violation", "Non-canonical label")
    kind = F.when(F.col("status") == "failed", "Invalid_JSON")
    parsed = F.when(F.col("provider").isNull(), F.col("cycle"))
    return a.select("attempt_id", ledger.failure_class(error, kind, F.col("status"), parsed, F.lit(None).cast("int")).alias("failure"))


@query("""SELECT conv_id, turn, text AS student_prompt, next_text AS teacher_response, next_text AS gold_answer, 'augmented' AS source_split, -1 AS source_idx, 2 AS origin_cycle, 'plain' AS teacher_model, 'coverage' AS prompt_operator
FROM v_sft WHERE trim(coalesce(text, '')) <> '' AND trim(coalesce(next_text, '')) <> ''""")
def augmented_projection(spark, sf_dir):
    from pyspark.sql import Window

    turns, w = v.table(spark, sf_dir, "conversations"), Window.partitionBy("conv_id").orderBy("turn")
    replied = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("teacher_response", F.lead("text").over(w)).where("role = 'user' and next_role = 'assistant'")
    prompts = replied.select("conv_id", "turn", F.col("text").alias("student_prompt"), "teacher_response")
    # The projection drops what it does not know, so the keys ride in one field and come back.
    packed = prompts.withColumn("student_prompt", F.to_json(F.struct("conv_id", "turn", "student_prompt"), {"ignoreNullFields": "false"})).where(F.trim(F.coalesce(prompts["student_prompt"], F.lit(""))) != "")
    key = F.from_json("student_prompt", "conv_id bigint, turn bigint, student_prompt string")
    made = validation.augmented_rows(packed, 2, "plain", "coverage").withColumn("key", key)
    return made.select("key.conv_id", "key.turn", "key.student_prompt", *[c for c in made.columns if c not in ("student_prompt", "key")])


# Joins, sets and unions.


@query("""SELECT run_id, policy, budget FROM v_runs WHERE run_id IN (SELECT run_id FROM v_attempts WHERE status = 'success')""")
def run_semi_join(spark, sf_dir):
    told = v.attempts(spark, sf_dir).where("status = 'success'")
    return v.runs(spark, sf_dir).join(told, "run_id", "left_semi").select("run_id", "policy", "budget")


@query("""SELECT c.run_id, c.cycle, round(c.metric, 6) AS metric, s.spent FROM v_cycles c LEFT JOIN (SELECT run_id, cycle, round(sum(t) OVER (PARTITION BY run_id ORDER BY cycle ROWS UNBOUNDED PRECEDING), 4) AS spent
  FROM (SELECT run_id, cycle, sum(coalesce(ledger, 0)) AS t FROM v_attempts GROUP BY 1, 2) g) s ON c.run_id = s.run_id AND c.cycle = s.cycle""")
def metrics_with_tokens(spark, sf_dir):
    from cinderloom.operators import quality_cost

    paid = v.attempts(spark, sf_dir).groupBy("run_id", "cycle").agg(F.sum(F.coalesce("ledger", F.lit(0.0))).alias("tokens"))
    spent = quality_cost.running_tokens(paid).select("run_id", "cycle", F.round("cumulative_tokens", 4).alias("spent"))
    return v.cycles(spark, sf_dir).join(spent, ["run_id", "cycle"], "left").select("run_id", "cycle", *r6("metric"), "spent")


@query("""SELECT subset, string_agg(DISTINCT policy, ',' ORDER BY policy) AS policies, count(DISTINCT seed) AS seeds FROM v_runs GROUP BY subset""")
def distinct_sets(spark, sf_dir):
    return v.runs(spark, sf_dir).groupBy("subset").agg(F.array_join(F.array_sort(F.collect_set("policy")), ",").alias("policies"), F.count_distinct("seed").alias("seeds"))


@query("""SELECT subset, budget, array_to_string(list_sort(list_intersect(a, b)), ',') AS common, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS every
FROM (SELECT subset, budget, coalesce(list(DISTINCT policy) FILTER (seed = 0), []) AS a, coalesce(list(DISTINCT policy) FILTER (seed = 1), []) AS b FROM v_cells GROUP BY 1, 2) t""")
def label_set_algebra(spark, sf_dir):
    of = lambda s: F.collect_set(F.when(F.col("seed") == s, F.col("policy")))
    g = v.cells(spark, sf_dir).groupBy("subset", "budget").agg(of(0).alias("a"), of(1).alias("b"))
    return g.select("subset", "budget", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("common"), F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("every"))


@query("""SELECT run_id, policy, final, CAST(NULL AS BIGINT) AS cycles FROM v_runs UNION ALL SELECT run_id, NULL, NULL, count(*) FROM v_cycles GROUP BY run_id""")
def multi_root_union(spark, sf_dir):
    other = v.cycles(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("cycles"))
    return validation.union_all(v.runs(spark, sf_dir).select("run_id", "policy", "final"), other)


# Aggregates of reports.


@query("""SELECT policy, budget, cycle, round(avg(total_tokens), 6) AS x, round(avg(value), 6) AS y FROM (SELECT r.policy, r.budget, c.cycle, sum(tokens) OVER (PARTITION BY c.run_id ORDER BY c.cycle ROWS UNBOUNDED PRECEDING) AS total_tokens, metric AS value
  FROM v_cycles c JOIN v_runs r ON c.run_id = r.run_id) p WHERE policy IN (SELECT DISTINCT policy FROM v_runs ORDER BY policy LIMIT 6) GROUP BY 1, 2, 3""")
def policy_curves(spark, sf_dir):
    from cinderloom.operators import quality_cost

    points = quality_cost.running_tokens(v.cycles(spark, sf_dir)).join(v.runs(spark, sf_dir).select("run_id", "policy", "budget"), "run_id")
    rows = bookkeeping.policy_curves(points.select("policy", "budget", "cycle", F.col("cumulative_tokens").alias("total_tokens"), F.col("metric").alias("value")))
    return rows.select("policy", "budget", "cycle", *r6("x", "y"))


@query("""SELECT policy, operator, round(sum(share), 6) AS share FROM (SELECT r.policy, a.operation AS operator, a.run_id, count(*) / sum(count(*)) OVER (PARTITION BY a.run_id) AS share FROM v_attempts a JOIN v_runs r ON a.run_id = r.run_id GROUP BY 1, 2, 3) s GROUP BY 1, 2""")
def operator_shares(spark, sf_dir):
    from pyspark.sql import Window

    counts = v.attempts(spark, sf_dir).join(v.runs(spark, sf_dir).select("run_id", "policy"), "run_id").groupBy("policy", F.col("operation").alias("operator"), "run_id").agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("run_id")))
    return bookkeeping.operator_shares(shares).select("policy", "operator", *r6("share"))


@query("""SELECT count(*) FILTER (pred = "true") AS agree, count(*) FILTER (pred <> "true") AS disagree, count(*) AS n, round(count(*) FILTER (pred <> "true") / greatest(1, count(*)), 6) AS disagreement_rate FROM v_labels""")
def agreement_counters(spark, sf_dir):
    return materialize.agreement(v.labelled(spark, sf_dir), "pred", "true").select("agree", "disagree", "n", *r6("disagreement_rate"))


@query("""SELECT idx, CAST(arg_min(label, loss) AS INTEGER) AS pred, round(exp(-min(loss)) / sum(exp(-loss)), 6) AS conf FROM (SELECT vec_id AS idx, i - 1 AS label, CAST(embedding[i] AS DOUBLE) AS loss FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) e) t GROUP BY idx""")
def label_scores_decoded(spark, sf_dir):
    losses = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.posexplode("embedding").alias("label", "x")).select("idx", "label", F.col("x").cast("double").alias("loss"))
    return predictions.label_scores_decoded(losses).select("idx", "pred", *r6("conf"))


# Samples.


@query("""SELECT id, label FROM (SELECT id, label FROM v_train ORDER BY id LIMIT 40) t""")
def source_prefix(spark, sf_dir):
    return selection.source_selection(v.train(spark, sf_dir), "prefix", 40, "id").select("id", "label")


@query("""SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) = 1 AS covers FROM v_train ) t ORDER BY covers DESC, CASE WHEN covers THEN label END, id LIMIT 40""")
def source_stratified(spark, sf_dir):
    return selection.source_selection(v.train(spark, sf_dir).select("id", "label"), "stratified", 40, "id", "label").select("id", "label")


# Teacher calls.


def length_teacher():
    """A fixed teacher for the query: its usage follows from the prompt's length."""
    from cinderloom.operators.teaching import Reply

    async def call(prompt: str) -> Reply:
        n = len(prompt)
        return Reply("kept" if n % 3 else "refused", max(1, n // 3), n % 64, max(1, n // 3) + n % 64)

    return call


@query("""WITH RECURSIVE d AS (SELECT doc_id, length(text) AS n, greatest(1, length(text) // 3) + 64 AS bound, greatest(1, length(text) // 3) + length(text) % 64 AS paid FROM documents WHERE text IS NOT NULL),
  s AS (SELECT *, (SELECT sum(bound) // 2 FROM d) AS budget, sum(paid) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - paid AS spent FROM d),
  m AS (SELECT *, max(CAST(spent + bound > budget AS INTEGER)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS stopped, sum(CAST(spent + bound > budget AS INTEGER)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS nth FROM s)
SELECT doc_id, CASE WHEN stopped = 1 THEN 'masked' ELSE 'success' END AS status, CAST(CASE WHEN stopped = 1 THEN 0 ELSE paid END AS BIGINT) AS ledger, stopped = 0 AND n % 3 <> 0 AS accepted, CAST(budget - spent AS BIGINT) AS before, CAST(budget - spent - CASE WHEN stopped = 1 THEN 0 ELSE paid END AS BIGINT) AS after
FROM m WHERE stopped = 0 OR (nth = 1 AND spent + bound > budget)""")
def teacher_leases(spark, sf_dir):
    from cinderloom.operators import teaching

    rows = v.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", (fn.tokens_floor(F.length("text")) + 64).alias("bound"))
    # The budget follows the table: half of what all calls may cost.
    budget = rows.agg(F.expr("sum(bound) div 2")).first()[0]
    told = teaching.taught(rows, ["doc_id"], "text", "bound", length_teacher, budget, accept=F.col("reply") == "kept")
    return told.attempts.select("doc_id", "status", "ledger", "accepted", "before", "after")


# Templates and generation.

TEMPLATE = "Run {{ run_id }}: {% if control %}control {{ control }}{% else %}plain{% endif %}, {% for w in words %}{{ loop.index }}.{{ w | lower }};{% endfor %} {{ operator }}/{{ budget }}/{{ note | default('-') }}{% if subset == 'FRANCE' %} *{% endif %}"


@query("""SELECT run_id, 'Run ' || run_id || ': ' || CASE WHEN control <> '' THEN 'control ' || control ELSE 'plain' END || ', ' || array_to_string(list_transform(string_split(policy, '-'), lambda w, i: CAST(i AS VARCHAR) || '.' || lower(w) || ';'), '')
  || ' repair/' || budget || '/' || CASE WHEN seed = 1 THEN 'one' ELSE '-' END || CASE WHEN subset = 'FRANCE' THEN ' *' ELSE '' END AS prompt FROM v_runs""")
def template_render(spark, sf_dir):
    from cinderloom.functions import templates

    rows = v.runs(spark, sf_dir).withColumn("words", F.split("policy", "-")).withColumn("note", F.when(F.col("seed") == 1, "one"))
    # The row's budget stands over the variable of that name; the operator is a variable.
    return rows.select("run_id", templates.rendered(rows, TEMPLATE, {"operator": "repair", "budget": "none"}).alias("prompt"))


def first_words():
    """A fixed model for the query: the beginning of each prompt."""
    return lambda prompts: [p[:12] + "!" for p in prompts]


@query("""SELECT conv_id, turn, left(text, 12) || '!' AS reply, true AS cached FROM conversations WHERE role = 'user' AND text IS NOT NULL""")
def generation_cache_eval(spark, sf_dir):
    from cinderloom.operators.generation import Cache, Key
    from cinderloom.sources.staging import new_folder

    turns = v.table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", "text")
    cache, key = Cache(spark, new_folder(spark, "cache")), Key(1, "first-words", "all")
    # The even conversations first, then all of them; the third evaluation finds every reply.
    for some in (turns.where("conv_id % 2 = 0"), turns):
        cache.replies(some, "text", first_words, key, "turn")
    cache.compact(key)
    return cache.replies(turns, "text", first_words, key, "turn").select("conv_id", "turn", "reply", "cached")


# Plug-ins: metrics and sample contexts.


@query("""WITH RECURSIVE p AS (SELECT idx % 4 AS g, pred, "true", round(conf, 9) AS score, pred = "true" AS positive FROM v_pred ), n AS (SELECT g, count(*) AS n, count(*) FILTER (positive) AS hits FROM p GROUP BY 1),
t AS (SELECT g, "true" AS k, count(*) AS t FROM p GROUP BY 1, 2), q AS (SELECT g, pred AS k, count(*) AS q FROM p GROUP BY 1, 2),
m AS (SELECT n.g, n.n::DOUBLE AS n, hits::DOUBLE AS hits, (SELECT sum(t * q)::DOUBLE FROM t JOIN q ON t.g = q.g AND t.k = q.k WHERE t.g = n.g) AS chance, (SELECT sum(t * t)::DOUBLE FROM t WHERE t.g = n.g) AS tt, (SELECT sum(q * q)::DOUBLE FROM q WHERE q.g = n.g) AS qq FROM n),
r AS (SELECT g, positive, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2.0::DOUBLE AS r FROM p)
SELECT g, 'kappa' AS metric, round((n * hits - chance) / (n * n - chance), 6) AS value FROM m UNION ALL SELECT g, 'matthews', round((n * hits - chance) / sqrt((n * n - tt) * (n * n - qq)), 6) FROM m
UNION ALL SELECT g, 'auroc', round((sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0::DOUBLE) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)), 6) FROM r GROUP BY g""")
def metric_plugins(spark, sf_dir):
    from cinderloom.operators import metrics

    rows = v.predictions(spark, sf_dir).select((F.col("idx") % 4).alias("g"), "pred", "true", F.round("conf", 9).alias("score"), (F.col("pred") == F.col("true")).alias("positive"))
    return metrics.evaluated(rows, ["kappa", "matthews", "auroc"], "g").select("g", "metric", *r6("value"))


@query("""WITH RECURSIVE p AS (SELECT idx, idx % 7 AS run, pred, "true", round(conf, 9) AS conf, round(entropy, 9) AS entropy FROM v_pred ), f AS (SELECT *, row_number() OVER (PARTITION BY run, "true" ORDER BY idx) AS n FROM p)
SELECT run, 'few_shot_samples' AS collection, CAST(row_number() OVER (PARTITION BY run ORDER BY "true", n) AS INTEGER) AS place, idx FROM f WHERE n <= 2
UNION ALL SELECT run, 'high_entropy_samples', CAST(n AS INTEGER), idx FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY entropy DESC, idx) AS n FROM p) e WHERE n <= 5
UNION ALL SELECT run, 'hard_negative_samples', CAST(n AS INTEGER), idx FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY conf DESC, idx) AS n FROM p WHERE pred <> "true") h WHERE n <= 5""")
def sample_contexts(spark, sf_dir):
    from cinderloom.operators import contexts

    rows = v.predictions(spark, sf_dir).select("idx", (F.col("idx") % 7).alias("run"), "pred", "true", F.round("conf", 9).alias("conf"), F.round("entropy", 9).alias("entropy"))
    return contexts.contexts(contexts.candidates(rows)).select("run", "collection", "place", "idx")


# Nested documents.


@query("""SELECT c.click_id, j.fullkey AS path, CASE WHEN j.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN j.type = 'VARCHAR' THEN 'string' ELSE lower(j.type) END AS kind, CAST(j.value AS VARCHAR) AS value
FROM (SELECT click_id, props FROM clicks WHERE json_valid(props)) c, json_tree(c.props) j WHERE j.type NOT IN ('OBJECT', 'ARRAY') OR CAST(j.value AS VARCHAR) IN ('{}', '[]')""")
def json_paths(spark, sf_dir):
    from cinderloom.operators import documents

    return documents.flattened(v.table(spark, sf_dir, "clicks"), ["click_id"], "props")


_RUN_CONFIG = "'{{\"name\": \"' || run_id || '\", \"trainer\": {{\"splits\": [' || CAST(run_id % 2 AS {t}) || '], \"rate\": 0.5}}, \"seed\": ' || CAST(seed AS {t}) || '}}'"


@query("""WITH RECURSIVE c AS (SELECT dataset, subset, seed, budget, run_id, 'n' || run_id % 3 AS experiment, policy, CASE WHEN run_id % 7 = 0 THEN '' ELSE 'space' || seed END AS action_space, run_id % 4 AS n, run_id % 2 AS cfg FROM v_cells WHERE policy IN ('2-HIGH', '5-LOW')),
s AS (SELECT dataset, subset, seed, budget, run_id, 'space' || seed AS action_space, run_id % 4 AS n, run_id % 2 AS cfg FROM v_cells WHERE policy = '1-URGENT'), p AS (SELECT dataset, subset, seed, budget, 'n' || run_id % 3 AS name, '2-HIGH' AS policy FROM s WHERE run_id % 5 <> 0)
SELECT c.dataset, c.subset, c.seed, c.budget, c.run_id, x.problem FROM c LEFT JOIN p USING (dataset, subset, seed, budget) LEFT JOIN s USING (dataset, subset, seed, budget),
  LATERAL (SELECT 'unplanned' AS problem WHERE p.name IS NULL UNION ALL SELECT 'name_mismatch' WHERE p.name <> c.experiment UNION ALL SELECT 'policy_mismatch' WHERE p.policy <> c.policy UNION ALL SELECT 'count_mismatch' WHERE s.n <> c.n
    UNION ALL SELECT 'action_space_mismatch' WHERE s.run_id IS NOT NULL AND (c.action_space = '' OR c.action_space <> s.action_space) UNION ALL SELECT 'config_mismatch' WHERE s.cfg <> c.cfg) x
UNION ALL SELECT dataset, subset, seed, budget, min(run_id), 'duplicate_control' FROM c GROUP BY 1, 2, 3, 4 HAVING count(*) > 1
UNION ALL SELECT dataset, subset, seed, budget, NULL, 'missing' FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.dataset = p.dataset AND c.subset = p.subset AND c.seed = p.seed AND c.budget = p.budget)""")
def same_count_reconciliation(spark, sf_dir):
    from cinderloom.plans import same_count

    keys = ["dataset", "subset", "seed", "budget"]
    cells = v.cells(spark, sf_dir).withColumn("experiment", F.concat(F.lit("n"), (F.col("run_id") % 3).cast("string"))).withColumn("synthetic_count", F.col("run_id") % 4).withColumn("config", F.expr(_RUN_CONFIG.format(t="STRING")))
    space = F.concat(F.lit("space"), F.col("seed").cast("string"))
    columns = [*keys, "run_id", "experiment", "policy", "action_space", "synthetic_count", "config"]
    controls = cells.where("policy in ('2-HIGH', '5-LOW')").withColumn("action_space", F.when(F.col("run_id") % 7 == 0, "").otherwise(space)).select(*columns)
    sources = cells.where("policy = '1-URGENT'").withColumn("action_space", space).select(*columns)
    planned = sources.where("run_id % 5 <> 0").select(*keys, F.col("experiment").alias("control_name"), F.lit("2-HIGH").alias("control_policy"), F.col("synthetic_count").alias("synthetic_record_budget"))
    return same_count.reconcile_runs(planned, controls, sources, keys, volatile=["name"]).select(*keys, "run_id", "problem")
