"""DuckDB SQL giving the expected rows of each query in pairflow.catalog.

Written from the definitions rather than from the Spark plans: windows where Spark uses aggregates,
self-joins where it uses bit masks, nested loops where it uses running maxima.
"""

from __future__ import annotations

from pairflow import domain
from pairflow.functions.text import FULL_STEPS

LABELS = domain.LABELS
MODEL = domain.MODEL_FEATURES
ALL = domain.FEATURES


def _hash(text: str) -> str:
    return f"(('0x' || substr(md5({text}),1,8))::bigint)"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _map(expr: str, mapping: dict, default: str = "NULL") -> str:
    def lit(v):
        return _q(v) if isinstance(v, str) else (f"cast({v!r} as double)" if isinstance(v, float) else str(v))
    return "CASE " + expr + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


WORDS = r"[\p{L}\p{N}_]+"
VISIBLE = r"[^\s\x0b\p{Z}\x1c-\x1f\x85]"


def _tok(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORDS}')"


def _full_tokens(text: str) -> str:
    """The rules of the full tokeniser, in the other engine's dialect; tests hold them against goldens."""
    out = f"lower({text})"
    for rules in FULL_STEPS.values():
        for pattern, replacement in rules:
            out = f"regexp_replace({out}, {_q(pattern)}, {_q(replacement.replace('$', chr(92)))}, 'g')"
    return f"regexp_extract_all({out}, '\\S+')"


def _parse(expr: str) -> str:
    return (f"CASE WHEN contains({expr}, 'entailment') THEN 'entailment' WHEN contains({expr}, 'contradiction') "
            f"THEN 'contradiction' WHEN contains({expr}, 'neutral') THEN 'neutral' WHEN contains({expr}, 'entail') "
            f"THEN 'entailment' WHEN contains({expr}, 'contradict') THEN 'contradiction' END")


def _pairs_from(arrays: str) -> str:
    genres = "[" + ", ".join(_q(g) for g in domain.GENRES) + "]"
    return f"""
 {arrays}_p AS (SELECT doc_id, source, arr, unnest(range(0, greatest(len(arr)-1, 1))) i FROM {arrays} WHERE len(arr) > 0),
 {arrays}_q AS (SELECT concat(doc_id, '-', i) pairID, arr[i+1] premise, coalesce(arr[i+2], '') hypothesis,
   {genres}[cast(substr(source,4) AS int) % 10 + 1] genre FROM {arrays}_p)"""


_SHARE = "length(hypothesis) * 100"
_WHOLE = "(length(premise) + length(hypothesis))"
LABEL_ID = f"(CASE WHEN hypothesis = '' THEN -1 WHEN {_SHARE} < 42 * {_WHOLE} THEN 2 WHEN {_SHARE} < 58 * {_WHOLE} THEN 1 ELSE 0 END)::int"
LABEL = _map("label_id", domain.LABEL_BY_ID, "'unknown'")
EST = _map("strategy", domain.ROUTER_TOKENS)


def _features(source: str, name: str) -> str:
    neg = "[" + ", ".join(_q(n) for n in domain.NEGATIONS) + "]"
    return f"""
 {name}_t AS (SELECT *, {_tok('premise')} p, {_tok('hypothesis')} h FROM {source}),
 {name}_s AS (SELECT *, list_distinct(p) ps, list_distinct(h) hs FROM {name}_t),
 {name}_u AS (SELECT *, len(list_intersect(ps, hs)) sw, len(list_distinct(list_concat(ps, hs))) un FROM {name}_s),
 {name} AS (SELECT * EXCLUDE (p, h, ps, hs, sw, un),
   len(p)::int premise_length, len(h)::int hypothesis_length, (len(p)+len(h))::int combined_length,
   len(h)::double / greatest(len(p),1) length_ratio, (length(premise)+length(hypothesis))::int char_length,
   len(list_intersect(ps, {neg}))::int premise_negations, len(list_intersect(hs, {neg}))::int hypothesis_negations,
   (len(list_intersect(ps, {neg})) + len(list_intersect(hs, {neg})))::int total_negations,
   sw::double / greatest(un,1) jaccard_similarity, sw::double / greatest(un,1) lexical_overlap,
   sw::double / greatest(len(hs),1) hypothesis_overlap, sw::double / greatest(len(ps),1) premise_coverage,
   sw::int shared_words FROM {name}_u)"""


PROFILE = "VALUES ('zero-shot',0.0,0.3),('one-shot',0.05,0.25),('few-shot',0.1,0.2),('cot',0.1,0.3),('6-shot',0.05,0.2),('6-shot-cot',0.15,0.25)"


def _prompt(template: str) -> str:
    """SQL concatenation of a prompt text with its slots."""
    text = template.replace("{system_instruction}", domain.SYSTEM_INSTRUCTION)
    text = _q(text)
    for slot in ("premise", "hypothesis"):
        text = text.replace("{" + slot + "}", f"' || {slot} || '")
    return "(" + text + ")"


def _few(k: int) -> str:
    block = "".join(domain.FEW_SHOT_EXAMPLE.format(premise=p, hypothesis=h, label=l) for p, h, l in domain.FEW_SHOT_EXAMPLES[:k])
    return _prompt(domain.FEW_SHOT_HEADER + block + domain.FEW_SHOT_FOOTER)


PROMPTS = {
    "zero-shot": _prompt(domain.ZERO_SHOT_TEXT), "one-shot": _prompt(domain.ONE_SHOT_TEXT), "few-shot": _few(5),
    "6-shot": _few(6), "6-shot-cot": _prompt(domain.SIX_SHOT_COT_TEXT), "cot": _prompt(domain.COT_WITH_EXAMPLE_TEXT),
}
PROMPT_LENGTH = "CASE strategy " + " ".join(f"WHEN '{n}' THEN length({t})" for n, t in PROMPTS.items()) + " END"

# name -> (needed parts, CTE text)
PARTS: dict[str, tuple[list[str], str]] = {
    "pairs": ([], """
 a AS (SELECT doc_id, source, list_filter(list_transform(regexp_extract_all(text, '[^.\\n]+'), lambda x: trim(x)), lambda x: x <> '') arr FROM documents),"""
              + _pairs_from("a") + f""",
 raw AS (SELECT pairID, premise, hypothesis, genre, {LABEL_ID} label_id FROM a_q),
 pairs AS (SELECT *, {LABEL} AS label FROM raw)"""),
    "turns": ([], f"""
 t_j AS (SELECT concat('c-', x.conv_id, '-', x.turn) pairID, x.text premise, y.text hypothesis, 'facetoface' genre
   FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
 turns AS (SELECT pairID, premise, hypothesis, genre, {LABEL_ID} label_id FROM t_j)"""),
    "clean": (["pairs"], f"""
 clean AS (SELECT * FROM pairs WHERE label IN {_in(LABELS)} AND regexp_matches(premise, '{VISIBLE}') AND regexp_matches(hypothesis, '{VISIBLE}')
   QUALIFY row_number() OVER (PARTITION BY premise, hypothesis ORDER BY pairID) = 1)"""),
    "feats": (["pairs"], _features("pairs", "feats")),
    "cfeats": (["clean"], _features("clean", "cfeats")),
    "routed": (["feats"], """
 routed AS (SELECT *, CASE WHEN lower(genre) IN ('government','oup') THEN '6-shot-cot'
   WHEN char_length > 100 AND total_negations >= 1 AND lexical_overlap < 0.4 THEN '6-shot' ELSE 'zero-shot' END routed_strategy FROM feats)"""),
    "routed_default": (["feats"], """
 routed_default AS (SELECT *, CASE WHEN lower(genre) IN ('government','oup') THEN '6-shot-cot'
   WHEN char_length > 220 AND total_negations >= 3 AND lexical_overlap < 0.4 THEN '6-shot' ELSE 'zero-shot' END routed_strategy FROM feats)"""),
    "sc": (["pairs"], f"""
 sc_0 AS (SELECT *, ({_hash("concat(pairID,'|difficulty')")} % 100)::double / 100 difficulty_score FROM pairs),
 sc_1 AS (SELECT *, greatest(difficulty_score, 1 - difficulty_score) routing_confidence FROM sc_0),
 sc AS (SELECT *, CASE WHEN difficulty_score < 0.6::double AND routing_confidence > 0.7::double THEN 'zero-shot' ELSE 'cot' END binary_strategy,
   CASE WHEN difficulty_score < 0.3::double AND routing_confidence > 0.7::double THEN 'zero-shot'
        WHEN difficulty_score > 0.6::double THEN 'cot' ELSE 'few-shot' END routed_strategy FROM sc_1)"""),
    "tiers": (["sc"], f"""
 tiers AS (SELECT *, {_map('routed_strategy', domain.ROUTER_TOKENS)} est FROM sc)"""),
    "preds": (["pairs"], f"""
 s(strategy, low, high) AS ({PROFILE}),
 p_w AS (SELECT *, list_distinct({_tok('premise')}) pw, list_distinct({_tok('hypothesis')}) hw FROM pairs),
 p_o AS (SELECT * EXCLUDE (pw, hw), len(hw) words, len(list_intersect(pw, hw)) shared FROM p_w),
 p_h AS (SELECT *, shared::double / greatest(words, 1) overlap FROM p_o CROSS JOIN s),
 p_n AS (SELECT *, CASE WHEN overlap >= high::double THEN 'entailment' WHEN overlap <= low::double THEN 'contradiction' ELSE 'neutral' END w,
   CASE WHEN words = 0 THEN 'Nothing to judge' END error FROM p_h),
 p_t AS (SELECT *, CASE WHEN error IS NOT NULL THEN '' WHEN words = 1 THEN 'cannot decide'
   WHEN strategy LIKE '%cot' THEN concat('Shared words: ', shared, ' of ', words, '. Classification: ', w) ELSE w END raw_response FROM p_n),
 preds AS (SELECT pairID, premise, hypothesis, genre, label_id, label, strategy, raw_response,
   {_parse('lower(trim(raw_response))')} predicted_label,
   cast({PROMPT_LENGTH} // 4 AS bigint)+1 prompt_tokens,
   CASE WHEN error IS NOT NULL THEN cast(0 AS bigint) ELSE cast(floor(length(raw_response)/4) AS bigint)+1 END response_tokens,
   NULL::double latency_ms, error IS NULL success, error FROM p_t)"""),
    "sample": (["clean"], """
 sample AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY genre, label ORDER BY md5(concat(pairID,'|42')), pairID)
   <= CASE label WHEN 'contradiction' THEN 16 ELSE 17 END)"""),
}


def _split(source: str) -> str:
    return f"""
 z_n AS (SELECT genre, label, count(*) n FROM {source} GROUP BY ALL),
 z_f AS (SELECT *, floor(n * 0.3::double) fl, n * 0.3::double - floor(n * 0.3::double) fr, ceil(sum(n) OVER () * 0.3::double) total FROM z_n),
 z_q AS (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, genre, label) <= total - sum(fl) OVER () THEN 1 ELSE 0 END quota FROM z_f),
 z_r AS (SELECT *, row_number() OVER (PARTITION BY genre, label ORDER BY md5(concat(pairID,'|42')), pairID) rn FROM {source}),
 splits AS (SELECT z_r.*, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END split FROM z_r JOIN z_q USING (genre, label))"""


PARTS["split_clean"] = (["clean"], _split("clean"))
PARTS["split_sample"] = (["sample"], _split("sample"))


def _metrics(source: str, keys: list[str], name: str = "m", true: str = "label", pred: str = "predicted_label") -> str:
    k = "".join(f"{c}, " for c in keys)
    on = " AND ".join([f"c.{c} IS NOT DISTINCT FROM o.{c}" for c in keys] or ["true"])
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    f1s = ", ".join(f"coalesce(max(f1) FILTER (label = '{l}'), 0)::double {l}_f1" for l in LABELS)
    return f"""
 {name}_v AS (SELECT {k}{true} t, {pred} q FROM {source} WHERE {pred} IS NOT NULL),
 {name}_d AS (SELECT DISTINCT {k}t label FROM {name}_v UNION SELECT DISTINCT {k}q FROM {name}_v),
 {name}_c AS (SELECT {"".join(f"o.{c}, " for c in keys)}o.label,
    count(*) FILTER (c.t = o.label AND c.q = o.label) tp, count(*) FILTER (c.t <> o.label AND c.q = o.label) fp,
    count(*) FILTER (c.t = o.label) support FROM {name}_d o JOIN {name}_v c ON {on} GROUP BY ALL),
 {name}_k AS (SELECT *, coalesce(tp::double / nullif(tp+fp,0), 0) prec, coalesce(tp::double / nullif(support,0), 0) rec FROM {name}_c),
 {name}_f AS (SELECT *, coalesce(2*tp::double / nullif(2*tp + fp + (support-tp), 0), 0) f1 FROM {name}_k),
 {name}_i AS (SELECT {k}count(*) FILTER ({pred} IS NULL) n_invalid FROM {source} {group}),
 {name}_a AS (SELECT {k}sum(tp)::double/sum(support) accuracy, avg(f1) macro_f1, sum(f1*support)/sum(support) weighted_f1,
    avg(prec) macro_precision, avg(rec) macro_recall, sum(support)::bigint n_samples, {f1s} FROM {name}_f {group}),
 {name} AS (SELECT c.*, o.n_invalid FROM {name}_a c JOIN {name}_i o ON {on})"""


METRIC_COLUMNS = ["accuracy", "macro_f1", "weighted_f1", "macro_precision", "macro_recall"]


def _r(cols, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) {c}" for c in cols)


REPORT = (_r(METRIC_COLUMNS) + ", n_samples, n_invalid, " + _r([f"{l}_f1" for l in LABELS]))

PARTS["m_all"] = (["preds"], _metrics("preds", [], "m_all"))
PARTS["m_strategy"] = (["preds"], _metrics("preds", ["strategy"], "m_strategy"))
PARTS["m_genre"] = (["preds"], _metrics("preds", ["genre"], "m_genre"))
PARTS["norm"] = (["preds"], " norm AS (SELECT genre, label, coalesce(predicted_label, 'none') predicted_label FROM preds)")
PARTS["m_norm"] = (["norm"], _metrics("norm", ["genre"], "m_norm"))
PARTS["right"] = (["preds"], """
 rt AS (SELECT pairID, strategy, label, coalesce(label = predicted_label, false) ok FROM preds),
 so(strategy, o) AS (VALUES ('zero-shot',0),('one-shot',1),('few-shot',2),('cot',3),('6-shot',4),('6-shot-cot',5)),
 pc AS (SELECT x.strategy strategy_a, y.strategy strategy_b, count(*) n_common, count(*) FILTER (x.ok) a_correct, count(*) FILTER (y.ok) b_correct,
   count(*) FILTER (x.ok AND NOT y.ok) a_only_correct, count(*) FILTER (NOT x.ok AND y.ok) b_only_correct
   FROM rt x JOIN rt y USING (pairID) JOIN so ox ON ox.strategy = x.strategy JOIN so oy ON oy.strategy = y.strategy WHERE ox.o < oy.o GROUP BY ALL)""")
PARTS["gs"] = (["preds"], """
 gs AS (SELECT strategy, genre, count(*) FILTER (label = predicted_label)::double / count(*) accuracy FROM preds WHERE predicted_label IS NOT NULL GROUP BY ALL)""")
PARTS["encoder"] = (["preds"], """
 src AS (SELECT 'zero-shot' strategy, label, predicted_label FROM preds WHERE strategy = 'zero-shot'
   UNION ALL SELECT 'encoder', upper(label), predicted_label FROM preds WHERE strategy = 'cot'
   UNION ALL SELECT 'few-shot', label, coalesce(predicted_label, 'nan') FROM preds WHERE strategy = 'few-shot'),
 srcn AS (SELECT strategy, lower(label) label, CASE WHEN predicted_label = 'nan' THEN NULL ELSE lower(predicted_label) END predicted_label FROM src)""")
PARTS["m_src"] = (["encoder"], _metrics("srcn", ["strategy"], "m_src"))

COST_IN = _map("strategy", {s: t[0] for s, t in domain.COST_TOKENS.items()}, str(domain.COST_TOKENS_DEFAULT[0]))
COST_OUT = _map("strategy", {s: t[1] for s, t in domain.COST_TOKENS.items()}, str(domain.COST_TOKENS_DEFAULT[1]))


def _costed(source: str, n: str = "n", name: str = "costed", extra: str = "") -> str:
    return f"""
 {name} AS (SELECT strategy, {n}, {extra} ({COST_IN} * {n})::bigint input_tokens, ({COST_OUT} * {n})::bigint output_tokens,
   (({COST_IN} + {COST_OUT}) * {n})::bigint total_tokens,
   ({COST_IN} * {n})::double / 1000 * 0.000075::double + ({COST_OUT} * {n})::double / 1000 * 0.0003::double cost_usd FROM {source})"""


PARTS["by_strategy"] = (["preds"], " by_strategy AS (SELECT strategy, count(*) n FROM preds GROUP BY ALL)")
PARTS["planned"] = (["pairs"], " planned AS (SELECT strategy, count(*) n FROM pairs CROSS JOIN (VALUES ('zero-shot'),('one-shot'),('few-shot'),('cot')) v(strategy) GROUP BY ALL)")
PARTS["rcounts"] = (["sc"], " rcounts AS (SELECT routed_strategy strategy, count(*) n FROM sc GROUP BY ALL)")
PARTS["cost_by_strategy"] = (["by_strategy"], _costed("by_strategy", name="cost_by_strategy"))
PARTS["cost_planned"] = (["planned"], _costed("planned", name="cost_planned"))
PARTS["cost_routed"] = (["rcounts"], _costed("rcounts", name="cost_routed"))
PARTS["cost_acc"] = (["m_strategy"], _costed("m_strategy", "n_samples", "cost_acc", "accuracy, macro_f1, "))
PARTS["partial"] = (["preds"], " part AS (SELECT * FROM preds WHERE success AND strategy IN ('zero-shot','one-shot','few-shot','cot'))")
PARTS["train"] = (["cfeats", "preds"], """
 train AS (SELECT c.*, CASE WHEN coalesce(c.label = z.predicted_label, false) THEN 0 ELSE 1 END target FROM cfeats c
   JOIN preds z ON z.pairID = c.pairID AND z.strategy = 'zero-shot' WHERE EXISTS (SELECT 1 FROM preds k WHERE k.pairID = c.pairID AND k.strategy = 'cot'))""")


def _newton(source: str, name: str, folds: list[int]) -> str:
    """Coefficients b of the balanced L2 logistic regression on the standardised model features, by twelve Newton
    steps of a recursive query with Gauss-Jordan elimination. Model g leaves out fold g; fold -1 is none."""
    n = len(MODEL) + 1
    scale = ", ".join(f"avg({c}::double) m{i}, coalesce(nullif(stddev_pop({c}::double), 0), 1) s{i}" for i, c in enumerate(MODEL))
    x = "[1.0::double, " + ", ".join(f"({c}::double - m{i}) / s{i}" for i, c in enumerate(MODEL)) + "]"
    sums = ", ".join([f"sum(w * p * (1 - p) * x[{i}] * x[{j}]) h{i}_{j}" for i in range(1, n + 1) for j in range(i, n + 1)]
                     + [f"sum(w * (target - p) * x[{i}]) g{i}" for i in range(1, n + 1)])
    matrix = ", ".join("[" + ", ".join(f"h{min(i, j)}_{max(i, j)}" + " + 1" * (i == j > 1) for j in range(1, n + 1))
                       + f", g{i} - {'0' if i == 1 else f'b[{i}]'}]" for i in range(1, n + 1))
    solved = f"""SELECT s, g, b, [{matrix}] a FROM (SELECT s, g, b, {sums} FROM (SELECT s, g, b, x, target, w,
      1 / (1 + exp(-list_dot_product(b, x))) p FROM {name}_n JOIN {name}_t USING (g) WHERE s < 12) GROUP BY s, g, b)"""
    for k in range(1, n + 1):
        solved = f"""SELECT s, g, b, list_transform(a, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / a[{k}][{k}])
      ELSE list_transform(r, lambda v, j: v - r[{k}] * a[{k}][j] / a[{k}][{k}]) END) a FROM ({solved})"""
    zeros = "[" + ", ".join(["0.0::double"] * n) + "]"
    return f"""
 {name}_m AS (SELECT {scale} FROM {source}),
 {name}_x AS MATERIALIZED (SELECT t.*, {x} x, (row_number() OVER (PARTITION BY target ORDER BY md5(concat(pairID,'|42')), pairID) % 5)::int fold
   FROM {source} t CROSS JOIN {name}_m),
 {name}_t AS MATERIALIZED (SELECT g, x, target, (count(*) OVER (PARTITION BY g))::double / (2 * count(*) OVER (PARTITION BY g, target)) w
   FROM {name}_x JOIN (SELECT unnest({folds}) g) ON fold <> g),
 {name}_n(s, g, b) AS (SELECT 0, g, {zeros} FROM (SELECT unnest({folds}) g) UNION ALL
   SELECT s + 1, g, list_transform(b, lambda v, i: v + a[i][{n + 1}]) FROM ({solved})),
 {name}_b AS MATERIALIZED (SELECT g, b FROM {name}_n WHERE s = 12)"""


PARTS["model"] = (["train"], _newton("train", "lr", [-1]))
PARTS["fold_models"] = (["train"], _newton("train", "cv", [0, 1, 2, 3, 4]))
_SCORE = "1 / (1 + exp(-list_dot_product(b, x)))"
_X = "[1.0::double, " + ", ".join(f"({c}::double - m{i}) / s{i}" for i, c in enumerate(MODEL)) + "]"
PARTS["scored"] = (["model"], f" scored AS (SELECT *, (p > 0.5)::int q FROM (SELECT f.*, 1 / (1 + exp(-list_dot_product(b, {_X}))) p FROM cfeats f CROSS JOIN lr_m CROSS JOIN lr_b))")
PARTS["oof"] = (["fold_models"], f" oof AS (SELECT *, (p > 0.5)::int q FROM (SELECT x.*, {_SCORE} p FROM cv_x x JOIN cv_b ON g = fold))")
PARTS["weights"] = (["model"], f" weights AS (SELECT unnest([{', '.join(_q(c) for c in MODEL)}]) feature, unnest(b[2:]) importance FROM lr_b)")
PARTS["oof_labels"] = (["oof"], " oof_labels AS (SELECT target::varchar l, q::varchar r FROM oof)")
PARTS["train_split"] = (["train", "split_clean"], " train_split AS (SELECT t.* FROM train t JOIN (SELECT pairID FROM splits WHERE split = 'train') USING (pairID))")
PARTS["split_model"] = (["train_split"], _newton("train_split", "ts", [-1]))
PARTS["model_tiers"] = (["split_model", "cfeats"], f"""
 mt_p AS (SELECT 1 / (1 + exp(-list_dot_product(b, {_X}))) p FROM cfeats JOIN splits USING (pairID) CROSS JOIN ts_m CROSS JOIN ts_b WHERE split = 'test'),
 mt_s AS (SELECT CASE WHEN p < 0.3::double AND greatest(p, 1 - p) > 0.7::double THEN 'zero-shot' WHEN p > 0.6::double THEN 'cot' ELSE 'few-shot' END routed_strategy FROM mt_p),
 model_tiers AS (SELECT *, {_map('routed_strategy', domain.ROUTER_TOKENS)} est FROM mt_s)""")
PARTS["m_oof"] = (["oof_labels"], _metrics("oof_labels", [], "m_oof", "l", "r"))


def _sql(body: str, *parts: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for dep in PARTS[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for part in parts:
        need(part)
    ctes = ",".join(PARTS[p][1] for p in order)
    return ("WITH RECURSIVE" if "_n(s, g, b)" in ctes else "WITH") + ctes + "\n" + body if order else body


FEW_OWN = (_prompt(domain.FEW_SHOT_HEADER)[:-1] + " || 'Premise: ' || hypothesis || '\nHypothesis: ' || premise || '\nClassification: ' || label || '\n\n' || "
           + _prompt(domain.FEW_SHOT_FOOTER)[1:])


def _digest(prompt: str, extra: str = "") -> str:
    return (f"SELECT pairID, md5({prompt}) prompt_md5, length({prompt})::int prompt_chars, "
            f"(length({prompt})//4 + 1)::bigint prompt_tokens{extra} FROM pairs")


PRED_COLS = "pairID, strategy, raw_response, predicted_label, prompt_tokens, response_tokens, latency_ms, success, error"
ATTEMPTS = "1::int attempts"
SCORED_COLS = PRED_COLS.replace("latency_ms, ", "")


def _quant(source: str, keys: str, col: str) -> str:
    return f"quantile_cont({col}::double, 0.25) q25, quantile_cont({col}::double, 0.5) q50, quantile_cont({col}::double, 0.75) q75"


def _box(col: str, key: str) -> str:
    return f"""SELECT "group", round(q25,6) q25, round(q50,6) q50, round(q75,6) q75,
  round(min(v) FILTER (v >= q25 - 1.5*(q75-q25) AND v <= q75 + 1.5*(q75-q25)), 6) whisker_low,
  round(max(v) FILTER (v >= q25 - 1.5*(q75-q25) AND v <= q75 + 1.5*(q75-q25)), 6) whisker_high,
  count(*) FILTER (v < q25 - 1.5*(q75-q25) OR v > q75 + 1.5*(q75-q25)) n_outliers, count(*) n, '{col}' feature
  FROM (SELECT {key} "group", {col}::double v FROM feats)
  JOIN (SELECT {key} "group", {_quant('feats', key, col)} FROM feats GROUP BY {key}) USING ("group") GROUP BY ALL"""


def _pareto(source: str) -> str:
    """Definition by distinct points: dominated if some point is better on one count and no worse on the other."""
    return f"""
 pt AS (SELECT DISTINCT cost_usd c, accuracy v FROM {source}),
 dom AS (SELECT DISTINCT x.c, x.v FROM pt x JOIN pt y ON (y.v > x.v AND y.c <= x.c) OR (y.c < x.c AND y.v >= x.v))"""


LABELER_STOP = "[" + ", ".join(_q(w) for w in domain.LABELER_STOPWORDS) + "]"
STOP = "[" + ", ".join(_q(w) for w in domain.STOPWORDS) + "]"


def _negated(text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {_q(n)})" for n in domain.LABELER_NEGATION_SUBSTRINGS) + ")"


FIRST = "QUALIFY row_number() OVER (PARTITION BY premise, hypothesis ORDER BY pairID) = 1"
CHI = domain.CHI2_1DF_95
STAT = "coalesce(pow(abs(a_only_correct - b_only_correct) - 1, 2)::double / nullif(a_only_correct + b_only_correct, 0), 0)"
REASON = ("CASE routed_strategy WHEN 'zero-shot' THEN printf('Easy query (score=%.2f, conf=%.2f)', difficulty_score, routing_confidence) "
          "WHEN 'cot' THEN printf('Hard query (score=%.2f), using reasoning', difficulty_score) "
          "ELSE printf('Medium difficulty (score=%.2f), using examples', difficulty_score) END")
STRATS = domain.STRATEGIES
_us = lambda s: s.replace("-", "_")



def _savings(source: str) -> str:
    return f"""SELECT routed_strategy, n, nq n_queries, atk adaptive_tokens, nq*500 baseline_tokens, nq*500 - atk tokens_saved, round((nq*500 - atk) * 100.0::double / (nq*500), 6) savings_pct, round(n * 100.0::double / nq, 6) strategy_pct
      FROM (SELECT routed_strategy, count(*) n, (SELECT count(*) FROM {source}) nq, (SELECT sum(est)::bigint FROM {source}) atk FROM {source} GROUP BY ALL)"""


ORACLE: dict[str, str] = {
    # sources and sinks
    "src1_read_split": _sql("SELECT pairID, premise, hypothesis, genre, label_id, label FROM pairs", "pairs"),
    "src2_decode_label": _sql("SELECT pairID, label_id, label FROM pairs", "pairs"),
    "src3_content_id": _sql("SELECT pairID, md5(concat_ws(chr(31), premise, hypothesis, genre)) content_id FROM pairs", "pairs"),
    "src4_validation_combined": _sql(f"SELECT pairID, premise, hypothesis, genre, {LABEL} AS label, source FROM (SELECT *, 'matched' source FROM raw UNION ALL SELECT *, 'mismatched' FROM turns)", "pairs", "turns"),
    "src5_read_predictions_csv": _sql("SELECT pairID, premise, hypothesis, genre, label, raw_response, predicted_label, prompt_tokens, response_tokens, latency_ms, success, error, strategy FROM preds WHERE strategy IN ('zero-shot','few-shot','cot')", "preds"),
    "src6_read_sample_csv": _sql("SELECT pairID, premise, hypothesis, genre, label FROM clean", "clean"),
    "snk1_write_splits": _sql("SELECT pairID, genre, label, split FROM splits UNION ALL SELECT pairID, genre, label, 'full' FROM splits", "split_sample"),
    "snk2_write_csv": _sql(f"SELECT pairID, label, {', '.join(f'round({c},6) {c}' if c in ('length_ratio','jaccard_similarity','hypothesis_overlap','premise_coverage','lexical_overlap') else c for c in ALL)} FROM feats", "feats"),
    "snk3_write_json": _sql(f"SELECT {PRED_COLS} FROM preds", "preds"),
    "snk6_validate_splits": _sql("SELECT split, count(*) samples, count(DISTINCT genre) genres, " + ", ".join(f"count(*) FILTER (label = '{l}') {l}" for l in LABELS) + " FROM (SELECT genre, label, split FROM splits UNION ALL SELECT genre, label, 'full' FROM splits) GROUP BY split", "split_sample"),
    # filters
    "flt1_valid_labels": _sql(f"SELECT pairID, label FROM pairs WHERE label IN {_in(LABELS)}", "pairs"),
    "flt2_drop_blank": _sql(f"SELECT pairID, premise, hypothesis FROM pairs WHERE regexp_matches(premise, '{VISIBLE}') AND regexp_matches(hypothesis, '{VISIBLE}')", "pairs"),
    "flt3_keep_first": _sql(f"SELECT pairID, premise, hypothesis, genre, label FROM pairs {FIRST}", "pairs"),
    "flt4_cleaning_report": _sql(f"""SELECT n_input, n_bad_label, n_blank, n_input - n_bad_label - n_blank - n_kept n_duplicate, n_kept, n_input - n_kept n_removed,
      round((n_input - n_kept) * 100.0::double / n_input, 6) removed_pct FROM (SELECT count(*) n_input, count(*) FILTER (label NOT IN {_in(LABELS)}) n_bad_label,
      count(*) FILTER (label IN {_in(LABELS)} AND NOT (regexp_matches(premise, '{VISIBLE}') AND regexp_matches(hypothesis, '{VISIBLE}'))) n_blank FROM pairs),
      (SELECT count(*) n_kept FROM clean)""", "clean"),
    "flt5_valid_predictions": _sql("SELECT strategy, count(predicted_label) n_valid, count(*) - count(predicted_label) n_invalid FROM preds GROUP BY ALL", "preds"),
    "flt6_stringified_nulls": _sql("SELECT strategy, count(predicted_label) n_valid, count(*) - count(predicted_label) n_invalid FROM preds GROUP BY ALL", "preds"),
    "flt7_normalise_labels": _sql("SELECT pairID, strategy, label, coalesce(predicted_label, 'none') predicted_label FROM preds", "preds"),
    "flt8_harmonise_columns": _sql("SELECT pairID, label, predicted_label, prompt_tokens, 'zero-shot' strategy FROM preds WHERE strategy = 'zero-shot' UNION ALL SELECT pairID, label, predicted_label, NULL, 'encoder' FROM preds WHERE strategy = 'cot'", "preds"),
    "flt9_feature_matrix": _sql(f"SELECT pairID, round({' + '.join(MODEL)}, 6) feature_sum, {', '.join(f'round({c}::double,6) {c}' for c in MODEL)} FROM feats", "feats"),
    "flt10_error_rows": _sql("SELECT pairID, strategy, label, predicted_label FROM preds WHERE predicted_label IS NOT NULL AND label <> predicted_label", "preds"),
    "flt11_rows_by_genre": _sql("SELECT genre, count(*) n, count(*) FILTER (label = predicted_label) n_correct FROM preds GROUP BY ALL", "preds"),
    # sampling
    "smp1_stratified_sample": _sql("SELECT pairID, genre, label FROM sample", "sample"),
    "smp2_sample_per_genre": _sql("SELECT pairID, genre, label FROM clean QUALIFY row_number() OVER (PARTITION BY genre ORDER BY md5(concat(pairID,'|42')), pairID) <= 50", "clean"),
    "smp3_shuffled_sample": _sql("SELECT pairID, genre, label, md5(concat(pairID,'|42')) shuffle_key FROM sample", "sample"),
    "smp4_short_strata": _sql("""SELECT g.genre, l.label, count(c.pairID) available, l.quota FROM (SELECT DISTINCT genre FROM clean) g CROSS JOIN
      (VALUES ('entailment', 467::bigint), ('neutral', 467), ('contradiction', 466)) l(label, quota) LEFT JOIN clean c ON c.genre = g.genre AND c.label = l.label GROUP BY ALL HAVING available < l.quota""", "clean"),
    "smp5_train_test_split": _sql("SELECT pairID, genre, label, split FROM splits", "split_clean"),
    "smp6_prepare": _sql("SELECT pairID, premise, hypothesis, genre, label, split FROM splits", "split_sample"),
    "smp7_one_per_genre": _sql("SELECT pairID, genre, premise, hypothesis, label FROM pairs WHERE genre IN ('fiction','government','telephone') QUALIFY row_number() OVER (PARTITION BY genre ORDER BY md5(concat(pairID,'|42')), pairID) = 1", "pairs"),
    # text
    "txt1_word_tokens": _sql(f"SELECT pairID, array_to_string({_tok('premise')}, ' ') tokens, len({_tok('premise')})::int n_tokens FROM pairs", "pairs"),
    "txt2_full_tokens": _sql(f"SELECT pairID, array_to_string({_full_tokens('premise')}, ' ') tokens, len({_full_tokens('premise')})::int n_tokens FROM pairs", "pairs"),
    "txt3_overlap_without_stopwords": _sql(f"""SELECT pairID, len(list_intersect(p, h))::int shared_words, round(len(list_intersect(p, h))::double / greatest(len(list_distinct(list_concat(p, h))),1), 6) jaccard_similarity,
      round(len(list_intersect(p, h))::double / greatest(len(h),1), 6) hypothesis_overlap, round(len(list_intersect(p, h))::double / greatest(len(p),1), 6) premise_coverage
      FROM (SELECT pairID, list_filter(list_distinct({_full_tokens('premise')}), lambda x: NOT list_contains({STOP}, x)) p, list_filter(list_distinct({_full_tokens('hypothesis')}), lambda x: NOT list_contains({STOP}, x)) h FROM pairs)""", "pairs"),
    "txt4_lengths": _sql("SELECT pairID, premise_length, hypothesis_length, combined_length, round(length_ratio,6) length_ratio, char_length FROM feats", "feats"),
    "txt5_negations": _sql("SELECT pairID, premise_negations, hypothesis_negations, total_negations FROM feats", "feats"),
    "txt6_overlap": _sql(f"SELECT pairID, {_r(['jaccard_similarity','lexical_overlap','hypothesis_overlap','premise_coverage'])}, shared_words FROM feats", "feats"),
    "txt7_all_features": _sql(f"SELECT pairID, {', '.join(f'round({c},6) {c}' if c in ('length_ratio','jaccard_similarity','hypothesis_overlap','premise_coverage','lexical_overlap') else c for c in ALL)} FROM feats", "feats"),
    "txt8_features_replace_columns": _sql(f"SELECT pairID, genre, label, {', '.join(f'round({c},6) {c}' if c in ('length_ratio','jaccard_similarity','hypothesis_overlap','premise_coverage','lexical_overlap') else c for c in ALL)} FROM cfeats", "cfeats"),
    "txt9_mean_word_counts": _sql(f"SELECT round(avg(len(regexp_extract_all(premise, '{VISIBLE}+'))), 6) avg_premise_words, round(avg(len(regexp_extract_all(hypothesis, '{VISIBLE}+'))), 6) avg_hypothesis_words FROM pairs", "pairs"),
    "txt10_approx_tokens": _sql("SELECT pairID, (length(premise)//4 + 1)::bigint premise_tokens, (length(hypothesis)//4 + 1)::bigint hypothesis_tokens FROM pairs", "pairs"),
    "txt11_truncate": _sql("SELECT pairID, CASE WHEN length(premise) > 100 THEN substr(premise,1,100) || '...' ELSE premise END premise_short, CASE WHEN length(hypothesis) > 50 THEN substr(hypothesis,1,50) || '...' ELSE hypothesis END hypothesis_short FROM pairs", "pairs"),
    "txt12_parse_label": _sql(f"""SELECT id, {_parse('x')} AS label, coalesce(regexp_extract_all(x, 'entailment|contradiction|neutral')[-1], CASE WHEN contains(x, 'entail') THEN 'entailment' WHEN contains(x, 'contradict') THEN 'contradiction' END) last_label
      FROM (SELECT concat(pairID, '/', strategy) id, lower(raw_response) x FROM preds UNION ALL SELECT concat(pairID, '/', strategy, '/wordy'), lower(concat('Not ENTAILED by: ', premise, '; rather ', raw_response)) FROM preds)""", "preds"),
    "txt13_canonical_strategy": _sql("SELECT strategy, CASE strategy WHEN 'cot' THEN 'Chain_Of_Thought' ELSE upper(replace(strategy,'-','_')) END given, count(*) n FROM preds GROUP BY ALL", "preds"),
    "txt14_zero_shot_prompt": _sql(_digest(PROMPTS["zero-shot"]), "pairs"),
    "txt15_one_shot_prompt": _sql(_digest(PROMPTS["one-shot"]), "pairs"),
    "txt16_few_shot_prompt": _sql(" UNION ALL ".join([_digest(_few(5), ", 'five' variant"), _digest(_few(6), ", 'six' variant"), _digest(FEW_OWN, ", 'custom' variant")]), "pairs"),
    "txt17_cot_prompt": _sql(_digest(PROMPTS["cot"], ", 'example' variant") + " UNION ALL " + _digest(_prompt(domain.COT_TEXT), ", 'plain' variant"), "pairs"),
    "txt18_six_shot_cot_prompt": _sql(_digest(PROMPTS["6-shot-cot"]), "pairs"),
    "txt19_prompt_by_strategy": _sql(" UNION ALL ".join(f"SELECT pairID, '{s}' strategy, md5({p}) prompt_md5 FROM pairs" for s, p in PROMPTS.items()), "pairs"),
    "txt20_routing_reason": _sql(f"SELECT pairID, routed_strategy, {REASON} routing_reasoning FROM sc", "sc"),
    "txt21_confusion_key": _sql("SELECT concat(label, ' → ', predicted_label) confusion_pair, count(*) n FROM preds WHERE predicted_label IS NOT NULL AND label <> predicted_label GROUP BY ALL", "preds"),
    "txt22_plausible_label": _sql(f"""SELECT pairID, CASE WHEN len(h) = 0 THEN (['entailment','neutral','contradiction'])[(toss % 3 + 1)::int]
      WHEN np <> nh AND len(list_intersect(p, h))::double / len(h) > 0.3::double THEN 'contradiction' WHEN len(list_intersect(p, h))::double / len(h) > 0.5::double THEN 'entailment'
      WHEN len(list_intersect(p, h))::double / len(h) > 0.2::double THEN CASE WHEN toss % 2 = 0 THEN 'entailment' ELSE 'neutral' END ELSE 'neutral' END plausible_label
      FROM (SELECT pairID, {_hash('pairID')} toss, {_negated('premise')} np, {_negated('hypothesis')} nh, list_filter(list_distinct({_tok('premise')}), lambda x: NOT list_contains({LABELER_STOP}, x)) p,
      list_filter(list_distinct({_tok('hypothesis')}), lambda x: NOT list_contains({LABELER_STOP}, x)) h FROM pairs)""", "pairs"),
    # routing
    "rte1_rule_routing": _sql("SELECT pairID, genre, routed_strategy FROM routed", "routed"),
    "rte2_rule_distribution": _sql("SELECT routed_strategy, count(*) n, round(count(*)::double / sum(count(*)) OVER (), 6) share FROM routed GROUP BY ALL", "routed"),
    "rte3_binary_routing": _sql("SELECT pairID, round(difficulty_score,6) difficulty_score, round(routing_confidence,6) routing_confidence, binary_strategy routed_strategy FROM sc", "sc"),
    "rte4_tiered_routing": _sql("SELECT pairID, round(difficulty_score,6) difficulty_score, round(routing_confidence,6) routing_confidence, routed_strategy FROM sc", "sc"),
    "rte5_no_model": _sql("SELECT pairID, 'few-shot' routed_strategy, 0.5::double difficulty_score, 0.5::double routing_confidence, 'No classifier available, using default strategy' routing_reasoning, 465::int estimated_tokens, false has_model FROM pairs", "pairs"),
    "rte6_confidence": _sql("SELECT pairID, round(routing_confidence,6) confidence FROM sc", "sc"),
    "rte7_batch_routing": _sql("SELECT pairID, routed_strategy, round(difficulty_score,6) difficulty_score, round(routing_confidence,6) routing_confidence, est::int estimated_tokens FROM tiers", "tiers"),
    "rte8_savings_estimate": _sql(_savings("tiers"), "tiers"),
    "rte9_routing_summary": _sql("""SELECT routed_strategy, n, tq total_queries, ts total_spent, tv total_saved, round(n::double / greatest(tq,1), 6) share, round(tv::double / greatest(ts+tv,1), 6) savings_ratio
      FROM (SELECT routed_strategy, count(*) n, (SELECT count(*) FROM tiers) tq, (SELECT sum(est)::bigint FROM tiers) ts, (SELECT sum(greatest(0, 500-est))::bigint FROM tiers) tv FROM tiers GROUP BY ALL)""", "tiers"),
    "rte10_share_within_genre": _sql("SELECT genre, " + ", ".join(f"round(count(*) FILTER (routed_strategy = '{s}')::double / count(*), 6) \"{_us(s)}\"" for s in STRATS) + " FROM routed GROUP BY genre", "routed"),
    # scoring
    "inf1_score_table": _sql(f"SELECT {SCORED_COLS}, {ATTEMPTS}, true timed FROM preds WHERE strategy = 'zero-shot'", "preds"),
    "inf2_bounded_concurrency": _sql(f"SELECT {SCORED_COLS.replace(', error', '')}, coalesce(error, '') error, {ATTEMPTS} FROM preds WHERE strategy = 'few-shot'", "preds"),
    "inf3_retries": _sql(f"SELECT success, error, {ATTEMPTS}, count(*) n FROM preds WHERE strategy = 'cot' GROUP BY ALL", "preds"),
    "inf4_batch_summary": _sql("SELECT strategy, count(*) FILTER (success) successful, count(*) FILTER (NOT success) failed, sum(prompt_tokens+response_tokens)::bigint total_tokens, round(sum(latency_ms),6) total_time_ms, count(*) FILTER (lower(error) LIKE '%rate limit%') retryable_failures, round(count(*) FILTER (success)::double / count(*), 6) success_rate FROM preds GROUP BY ALL", "preds"),
    "inf5_several_strategies": _sql("SELECT pairID, strategy, predicted_label, prompt_tokens, response_tokens FROM preds", "preds"),
    "inf6_token_limits": _sql("SELECT strategy, (CASE WHEN strategy LIKE '%cot%' THEN 600 ELSE 20 END)::int study_limit, (CASE strategy WHEN '6-shot-cot' THEN 500 ELSE 20 END)::int adaptive_limit, count(*) n FROM preds GROUP BY ALL", "preds"),
    "inf7_label_from_scores": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) v, len(embedding) // 3 t FROM embeddings),
 s AS (SELECT vec_id, list_sum(v[1:t]) a, list_sum(v[t+1:2*t]) b, list_sum(v[2*t+1:]) c FROM e)
SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 'contradiction' WHEN b >= c THEN 'entailment' ELSE 'neutral' END predicted_label FROM s""",
    "inf8_resume": _sql(f"SELECT pairID, strategy, raw_response, predicted_label, {ATTEMPTS} FROM preds WHERE strategy IN ('zero-shot','one-shot','few-shot','cot')", "preds"),
    "inf9_score_routed": _sql("SELECT pairID, p.strategy, (CASE p.strategy WHEN '6-shot-cot' THEN 500 ELSE 20 END)::int max_tokens, predicted_label, prompt_tokens, coalesce(error,'') error FROM routed r JOIN preds p USING (pairID) WHERE p.strategy = r.routed_strategy", "routed", "preds"),
    # metrics
    "met1_accuracy": _sql("SELECT strategy, round(count(*) FILTER (label = predicted_label)::double / count(*), 6) accuracy, count(*) n FROM preds GROUP BY ALL", "preds"),
    "met2_confusion_matrix": _sql(f"SELECT s.strategy, t.l \"true\", q.l pred, count(p.pairID) n FROM s CROSS JOIN (SELECT unnest({LABELS}) l) t CROSS JOIN (SELECT unnest({LABELS}) l) q LEFT JOIN preds p ON p.strategy = s.strategy AND p.label = t.l AND p.predicted_label = q.l GROUP BY ALL", "preds"),
    "met3_observed_confusion": _sql("SELECT t.l \"true\", q.l pred, count(p.pairID) n FROM (SELECT label l FROM preds WHERE predicted_label IS NOT NULL UNION SELECT predicted_label FROM preds WHERE predicted_label IS NOT NULL) t CROSS JOIN (SELECT label l FROM preds WHERE predicted_label IS NOT NULL UNION SELECT predicted_label FROM preds WHERE predicted_label IS NOT NULL) q LEFT JOIN preds p ON p.label = t.l AND p.predicted_label = q.l GROUP BY ALL", "preds"),
    "met4_per_class": _sql(f"SELECT strategy, label, round(prec,6) \"precision\", round(rec,6) recall, round(f1,6) f1, support FROM m_strategy_f WHERE label IN {_in(LABELS)}", "m_strategy"),
    "met5_macro_scores": _sql("SELECT genre, round(macro_f1,6) macro_f1, round(macro_precision,6) macro_precision, round(macro_recall,6) macro_recall FROM m_genre", "m_genre"),
    "met6_weighted_f1": _sql("SELECT strategy, round(weighted_f1,6) weighted_f1 FROM m_strategy", "m_strategy"),
    "met7_full_report": _sql(f"SELECT {REPORT} FROM m_all", "m_all"),
    "met8_per_genre": _sql(f"SELECT genre, {REPORT} FROM m_genre", "m_genre"),
    "met9_strategy_comparison": _sql(f"SELECT strategy, {REPORT} FROM m_strategy", "m_strategy"),
    "met11_top_confusions": _sql("SELECT strategy, confusion_pair, n FROM (SELECT strategy, concat(label, ' → ', predicted_label) confusion_pair, count(*) n FROM preds WHERE label <> predicted_label GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY n DESC, confusion_pair) <= 2", "preds"),
    # erfc(sqrt(s/2)) by the series of positive terms of erf, which is enough for six digits up to x = 5.5.
    "met13_mcnemar_p_value": _sql(f"""SELECT strategy_a, strategy_b, round(s, 6) AS statistic, round(CASE WHEN s = 0 THEN 1.0::double WHEN s > 60 THEN 0.0::double
  ELSE 1 - 2 / sqrt(pi()) * exp(-s / 2) * list_sum(list_transform(range(0, 250), lambda k:
   exp(2 * k * ln(2) + (2 * k + 1) * ln(sqrt(s / 2)) - lgamma(2 * k + 2) + lgamma(k + 1)))) END, 6) AS p_value
  FROM (SELECT strategy_a, strategy_b, {STAT} s FROM pc)""", "right"),
    "met13_mcnemar": _sql(f"SELECT strategy_a, strategy_b, a_only_correct, b_only_correct, round({STAT}, 6) statistic, {STAT} > {CHI}::double significant FROM pc", "right"),
    "met13_mcnemar_quality_toxic": f"""WITH pc AS (SELECT 'zero-shot' strategy_a, 'cot' strategy_b, count(*) n_common, count(*) FILTER (quality = 1) a_correct, count(*) FILTER (toxic = 0) b_correct,
      count(*) FILTER (quality = 1 AND toxic = 1) a_only_correct, count(*) FILTER (quality = 0 AND toxic = 0) b_only_correct FROM labels)
      SELECT *, round({STAT}, 6) statistic, {STAT} > {CHI}::double significant FROM pc""",
    "met14_crosstab_margins": _sql("SELECT coalesce(genre, 'All') genre, " + ", ".join(f"count(*) FILTER (label = '{l}') {l}" for l in LABELS + ["unknown"]) + ", count(*) \"All\" FROM pairs GROUP BY ROLLUP (genre)", "pairs"),
    "met15_crosstab": _sql("SELECT genre, " + ", ".join(f"count(*) FILTER (label = '{l}') {l}" for l in LABELS) + " FROM clean GROUP BY genre", "clean"),
    "met16_validation_report": _sql("SELECT count(*) total_samples, count(DISTINCT genre) unique_genres, (SELECT string_agg(genre, ',' ORDER BY genre) FROM (SELECT DISTINCT genre FROM pairs)) genres, count(*) FILTER (label = 'unknown') unknown_labels, " + ", ".join(f"count(*) FILTER (label = '{l}') n_{l}" for l in LABELS) + ", " + ", ".join(f"count(*) - count({c}) null_{c}" for c in ("pairID", "premise", "hypothesis", "genre", "label")) + " FROM pairs", "pairs"),
    "met17_sample_statistics": _sql(f"SELECT genre, count(*) total, (SELECT count(*) FROM clean) total_samples, (SELECT round(avg(len(regexp_extract_all(premise, '{VISIBLE}+'))), 6) FROM clean) avg_premise_words, (SELECT round(avg(len(regexp_extract_all(hypothesis, '{VISIBLE}+'))), 6) FROM clean) avg_hypothesis_words, " + ", ".join(f"(SELECT count(*) FILTER (label = '{l}') FROM clean) all_{l}" for l in LABELS) + ", " + ", ".join(f"count(*) FILTER (label = '{l}') {l}" for l in LABELS) + " FROM clean GROUP BY genre", "clean"),
    "met18_value_counts": _sql("SELECT 'genre' \"column\", genre \"value\", count(*) n, round(count(*)::double / sum(count(*)) OVER (), 6) share FROM pairs GROUP BY genre UNION ALL SELECT 'label', label, count(*), round(count(*)::double / sum(count(*)) OVER (), 6) FROM pairs GROUP BY label", "pairs"),
    "met19_accuracy_by_genre": _sql("SELECT strategy, genre, round(count(*) FILTER (label = predicted_label)::double / count(*), 6) accuracy, count(*) n FROM preds GROUP BY ALL", "preds"),
    "met20_normalised_by_genre": _sql("SELECT genre, round(accuracy,6) accuracy, round(macro_f1,6) macro_f1, n_samples FROM m_norm", "m_norm"),
    "met21_ranked_sources": _sql("SELECT strategy, round(count(*) FILTER (lower(label) = lower(predicted_label))::double / count(*), 6) accuracy, count(*) n FROM src GROUP BY ALL", "encoder"),
    "met21_detailed_sources": _sql("SELECT strategy, round(accuracy,6) accuracy, round(macro_f1,6) macro_f1, n_samples, n_invalid FROM m_src", "m_src"),
    "met22_improvement": _sql("SELECT round(x.accuracy,6) better, round(y.accuracy,6) base, round((x.accuracy - y.accuracy) * 100 / y.accuracy, 6) improvement_pct FROM m_strategy x, m_strategy y WHERE x.strategy = 'cot' AND y.strategy = 'zero-shot'", "m_strategy"),
    "met23_paired_counts": _sql("SELECT * FROM pc", "right"),
    "met24_feature_summary": _sql(" UNION ALL ".join(f"SELECT '{c}' feature, count({c}) count, round(avg({c}),2) mean, round(stddev_samp({c}),2) std, round(min({c})::double,2) min, round(max({c})::double,2) max, round(quantile_cont({c}::double,0.25),2) q25, round(quantile_cont({c}::double,0.5),2) q50, round(quantile_cont({c}::double,0.75),2) q75 FROM feats" for c in MODEL), "feats"),
    "met25_correlations": _sql(" UNION ALL ".join(f"SELECT '{a}' feature_a, '{b}' feature_b, round({'1.0::double' if a == b else f'corr({a}, {b})'},6) correlation FROM {'(SELECT 1)' if a == b else 'feats'}" for a in MODEL for b in MODEL), "feats"),
    "met26_box_stats": _sql(_box("combined_length", "genre") + " UNION ALL " + _box("jaccard_similarity", "label"), "feats"),
    "met27_mean_negations": _sql("SELECT genre, round(avg(total_negations),6) mean_total_negations FROM feats GROUP BY genre", "feats"),
    # cost
    "cst1_token_price": _sql("SELECT strategy, model, sum(prompt_tokens)::bigint input_tokens, sum(response_tokens)::bigint output_tokens, round(sum(prompt_tokens)::double/1000*pi + sum(response_tokens)::double/1000*po, 9) cost_usd FROM preds CROSS JOIN (VALUES " + ", ".join(f"('{m}', {a}::double, {b}::double)" for m, (a, b) in domain.PRICES.items()) + ") v(model, pi, po) GROUP BY strategy, model, pi, po", "preds"),
    "cst2_strategy_cost": _sql("SELECT strategy, n, input_tokens, output_tokens, total_tokens, round(cost_usd,9) cost_usd, round(cost_usd/n,9) cost_per_sample FROM cost_by_strategy", "cost_by_strategy"),
    "cst3_cost_comparison": _sql("SELECT strategy, n, input_tokens, output_tokens, total_tokens, round(cost_usd,9) cost_usd, round(cost_usd/n,9) cost_per_sample, round(cost_usd / (SELECT min(cost_usd) FROM cost_planned), 9) relative_cost FROM cost_planned", "cost_planned"),
    "cst4_adaptive_savings": _sql("""SELECT n total_samples, round(ac,9) adaptive_cost_usd, atk adaptive_tokens, round(bc,9) baseline_cost_usd, n*500 baseline_tokens, round(bc-ac,9) cost_savings_usd, round((bc-ac)/bc*100,9) cost_savings_pct, n*500-atk token_savings, round((n*500-atk)::double/(n*500)*100,9) token_savings_pct
      FROM (SELECT sum(n)::bigint n, sum(cost_usd) ac, sum(total_tokens)::bigint atk, (350*sum(n))::double/1000*0.000075::double + (150*sum(n))::double/1000*0.0003::double bc FROM cost_routed)""", "cost_routed"),
    "cst5_cost_accuracy": _sql("SELECT strategy, round(accuracy,9) accuracy, round(macro_f1,9) macro_f1, round(cost_usd,9) cost_usd, total_tokens, round(cost_usd/n_samples,9) cost_per_sample, round(accuracy/cost_usd,9) efficiency FROM cost_acc", "cost_acc"),
    "cst7_budget": _sql("""SELECT strategy, round(0.25::double,12) weight, 25.0::double budget_usd, round(w,12) avg_cost_per_sample, floor(25.0::double/w)::bigint max_samples, floor(floor(25.0::double/w)*0.25::double)::bigint strategy_samples
      FROM cost_planned CROSS JOIN (SELECT sum(cost_usd/n*0.25::double) w FROM cost_planned)""", "cost_planned"),
    "cst7_budget_by_routed_share": _sql("""SELECT strategy, round(n::double/t,12) weight, 25.0::double budget_usd, round(w,12) avg_cost_per_sample, floor(25.0::double/w)::bigint max_samples, floor(floor(25.0::double/w)*(n::double/t))::bigint strategy_samples
      FROM cost_routed CROSS JOIN (SELECT sum(n) t, sum(cost_usd) / sum(n) w FROM cost_routed)""", "cost_routed"),
    "cst9_planned_usage": _sql("SELECT strategy, n, (n*(p+50))::bigint estimated_tokens, round((n*p)::double/1000*0.000125::double + (n*50)::double/1000*0.000375::double,9) estimated_cost_usd, (p+50)::bigint tokens_per_sample FROM (SELECT *, " + _map("strategy", domain.PLANNED_PROMPT_TOKENS, "200") + " p FROM planned)", "planned"),
    "cst10_usage_summary": _sql("""SELECT strategy, prompt_tokens, response_tokens, calls, prompt_tokens+response_tokens total_tokens, round(prompt_tokens::double/greatest(calls,1),6) avg_prompt_tokens, round(response_tokens::double/greatest(calls,1),6) avg_response_tokens FROM
      (SELECT strategy, sum(prompt_tokens)::bigint prompt_tokens, sum(response_tokens)::bigint response_tokens, count(*) calls FROM preds WHERE strategy IN ('zero-shot','few-shot','cot') GROUP BY strategy
       UNION ALL SELECT 'one-shot', 0, 0, 0 UNION ALL SELECT 'total', sum(prompt_tokens)::bigint, sum(response_tokens)::bigint, count(*) FROM preds WHERE strategy IN ('zero-shot','few-shot','cot'))""", "preds"),
    "cst11_measured_savings": _sql("""SELECT nn n_rows, round(atk,6) adaptive_tokens, round(bt,6) baseline_tokens, round((bt-atk)*100/bt,6) savings_pct FROM (SELECT sum(n)::bigint nn, sum(n*t) atk, sum(n) * max(t) FILTER (strategy = 'cot') bt FROM
      (SELECT strategy, n, coalesce((SELECT avg(prompt_tokens)+avg(response_tokens) FROM preds p WHERE p.strategy = rcounts.strategy AND p.strategy IN ('zero-shot','cot')), 465::double) t FROM rcounts))""", "rcounts", "preds"),
    # joins, sets, shapes
    "jon1_append_features": _sql("SELECT pairID, premise, hypothesis, round(jaccard_similarity,6) jaccard_similarity, shared_words FROM feats", "feats"),
    "jon2_replay": _sql("SELECT pairID, p.strategy strategy_used, sc.label true_label, round(difficulty_score,6) difficulty_score, predicted_label FROM sc JOIN preds p USING (pairID) WHERE p.strategy = sc.routed_strategy", "sc", "preds"),
    "jon3_common_rows": _sql("SELECT pairID, label, predicted_label FROM part WHERE strategy = 'zero-shot' AND pairID IN (SELECT pairID FROM part WHERE strategy = 'cot')", "partial"),
    "jon3_alignment_report": _sql("""SELECT (SELECT count(*) FROM part WHERE strategy='zero-shot') n_left, (SELECT count(*) FROM part WHERE strategy='cot') n_right,
      (SELECT count(*) FROM part x JOIN part y USING (pairID) WHERE x.strategy='zero-shot' AND y.strategy='cot') n_common,
      (SELECT count(*) FROM part WHERE strategy='zero-shot' AND pairID NOT IN (SELECT pairID FROM part WHERE strategy='cot')) n_lost""", "partial"),
    "jon4_common_accuracies": _sql("""SELECT strategy, count(*) n, round(count(*) FILTER (label = predicted_label)::double/count(*),6) accuracy FROM
      (SELECT strategy, pairID, label, predicted_label FROM part UNION ALL SELECT 'adaptive', p.pairID, p.label, p.predicted_label FROM part p JOIN sc USING (pairID) WHERE p.strategy = sc.routed_strategy)
      WHERE pairID IN (SELECT pairID FROM part WHERE strategy='zero-shot') AND pairID IN (SELECT pairID FROM part WHERE strategy='cot') GROUP BY strategy""", "partial", "sc"),
    "jon5_dimension_lookup": _sql(f"SELECT strategy, n, ({COST_IN})::int input, ({_map('strategy', domain.ROUTER_TOKENS, '0')})::int router_tokens FROM by_strategy", "by_strategy"),
    "jon7_paired_correctness": _sql("SELECT x.ok a_correct, y.ok b_correct, count(*) n FROM rt x JOIN rt y USING (pairID) WHERE x.strategy = 'zero-shot' AND y.strategy = 'cot' GROUP BY ALL", "right"),
    "set1_union_sources": _sql("SELECT 'matched' source, genre, count(*) n FROM raw GROUP BY genre UNION ALL SELECT 'mismatched', genre, count(*) FROM turns GROUP BY genre", "pairs", "turns"),
    "set2_token_sets": _sql(f"SELECT pairID, len(list_intersect(p,h))::int n_both, len(list_distinct(list_concat(p,h)))::int n_either, (len(p) - len(list_intersect(p,h)))::int n_premise_only FROM (SELECT pairID, list_distinct({_tok('premise')}) p, list_distinct({_tok('hypothesis')}) h FROM pairs)", "pairs"),
    "set3_observed_labels": _sql("SELECT strategy, label FROM preds WHERE predicted_label IS NOT NULL UNION SELECT strategy, predicted_label FROM preds WHERE predicted_label IS NOT NULL", "preds"),
    "shp1_genre_by_strategy": _sql("SELECT genre, " + ", ".join(f"round(max(accuracy) FILTER (strategy = '{s}'),6) \"{_us(s)}\"" for s in STRATS) + " FROM gs GROUP BY genre", "gs"),
    "shp2_genre_improvement": _sql("SELECT x.genre, round(x.accuracy - y.accuracy, 6) improvement FROM gs x JOIN gs y USING (genre) WHERE x.strategy = 'cot' AND y.strategy = 'zero-shot'", "gs"),
    "shp3_class_f1_by_strategy": _sql("SELECT label, " + ", ".join(f"round(coalesce(max(f1) FILTER (strategy = '{s}'),0),6) \"{_us(s)}\"" for s in STRATS) + f" FROM m_strategy_f WHERE label IN {_in(LABELS)} GROUP BY label", "m_strategy"),
    "shp3_class_f1_long": _sql(f"SELECT strategy, label, round(f1,6) f1 FROM m_strategy_f WHERE label IN {_in(LABELS)}", "m_strategy"),
    "shp4_normalised_confusion": _sql(f"""SELECT strategy, \"true\", pred, n, round(n::double / nullif(sum(n) OVER (PARTITION BY strategy, \"true\"),0),6) share FROM (SELECT s.strategy, t.l \"true\", q.l pred, count(p.pairID) n FROM s CROSS JOIN (SELECT unnest({LABELS + ['none']}) l) t CROSS JOIN (SELECT unnest({LABELS + ['none']}) l) q
      LEFT JOIN preds p ON p.strategy = s.strategy AND p.label = t.l AND p.predicted_label = q.l GROUP BY ALL)""", "preds"),
    "shp5_progression": _sql("SELECT strategy, round(accuracy,6) accuracy, (" + _map("strategy", {s: i + 1 for i, s in enumerate(domain.BASE_STRATEGIES)}) + ")::int ord FROM m_strategy WHERE ord IS NOT NULL", "m_strategy"),
    "win1_first_per_key": _sql(f"SELECT pairID, label FROM pairs {FIRST}", "pairs"),
    "win2_ratio_to_minimum": _sql("SELECT strategy, round(cost_usd / (SELECT min(cost_usd) FROM cost_by_strategy), 6) relative_cost FROM cost_by_strategy", "cost_by_strategy"),
    "win3_share_of_total": _sql("SELECT routed_strategy, count(*) n, round(count(*)::double / sum(count(*)) OVER (), 6) share FROM sc GROUP BY ALL", "sc"),
    "srt1_sort_by_metric": _sql("SELECT genre, round(accuracy,6) accuracy FROM m_genre", "m_genre"),
    "srt3_restore_order": _sql("SELECT pairID, routed_strategy FROM routed", "routed"),
    "top1_top_error_pairs": _sql("SELECT concat(label, ' → ', predicted_label) confusion_pair, count(*) n FROM preds WHERE label <> predicted_label GROUP BY ALL ORDER BY n DESC, confusion_pair LIMIT 2", "preds"),
    "top1_top_genres": _sql("SELECT x.genre, round(x.accuracy - y.accuracy, 6) improvement FROM gs x JOIN gs y USING (genre) WHERE x.strategy = 'cot' AND y.strategy = 'zero-shot' ORDER BY x.accuracy - y.accuracy DESC, genre LIMIT 3", "gs"),
    "top2_best_strategy_matrix": _sql(f"SELECT b.strategy, t.l \"true\", q.l pred, count(p.pairID) n FROM (SELECT strategy FROM m_strategy ORDER BY accuracy DESC, strategy LIMIT 1) b CROSS JOIN (SELECT unnest({LABELS}) l) t CROSS JOIN (SELECT unnest({LABELS}) l) q LEFT JOIN preds p ON p.strategy = b.strategy AND p.label = t.l AND p.predicted_label = q.l GROUP BY ALL", "m_strategy"),
    # difficulty model
    "ml1_hard_target": _sql("SELECT pairID, target FROM train", "train"),
    "ml2_standardise": _sql("SELECT pairID, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) {c}_z" for c in MODEL) + " FROM cfeats", "cfeats"),
    "ml6_training_summary": _sql("SELECT count(*) n_samples, sum(target)::bigint n_hard, sum(1-target)::bigint n_easy FROM train", "train"),
    "snk4_write_summary": _sql("""SELECT best_strategy, round(best_accuracy,6) best_accuracy, round(cost_savings_pct,6) cost_savings_pct, round(token_savings_pct,6) token_savings_pct,
      round(gatekeeper_cv_accuracy,6) gatekeeper_cv_accuracy, strategy, round(accuracy,6) accuracy, round(macro_f1,6) macro_f1, n_samples
      FROM m_strategy, (SELECT strategy best_strategy, accuracy best_accuracy FROM m_strategy ORDER BY accuracy DESC, strategy LIMIT 1), (SELECT accuracy gatekeeper_cv_accuracy FROM m_oof),
      (SELECT (bc-ac)/bc*100 cost_savings_pct, (n*500-atk)::double/(n*500)*100 token_savings_pct FROM (SELECT sum(n)::bigint n, sum(cost_usd) ac, sum(total_tokens)::bigint atk,
        (350*sum(n))::double/1000*0.000075::double + (150*sum(n))::double/1000*0.0003::double bc FROM cost_routed))""", "m_strategy", "m_oof", "cost_routed"),
    "snk5_model_round_trip": _sql("SELECT pairID, q predicted_difficulty, round(p,4) difficulty_score, (SELECT round(accuracy,4) FROM m_oof) cv_accuracy FROM scored", "scored", "m_oof"),
    "srt2_sort_by_absolute": _sql("SELECT feature, round(importance,6) importance FROM weights", "weights"),
    "ml3_coefficients": _sql("SELECT feature, round(importance,6) importance FROM weights", "weights"),
    "ml4_out_of_fold": _sql("SELECT pairID, genre, target, fold, q predicted_difficulty, round(1-p,4) p_easy, round(p,4) p_hard FROM oof", "oof"),
    "ml5_cv_report": _sql("SELECT label, round(prec,6) AS precision, round(rec,6) recall, round(f1,6) f1, support FROM m_oof_f", "m_oof"),
    "ml7_top_importance": _sql("SELECT feature, round(importance,6) importance FROM weights ORDER BY abs(importance) DESC LIMIT 5", "weights"),
    "ml8_predict": _sql("SELECT pairID, q predicted_difficulty, round(1-p,4) p_easy, round(p,4) p_hard, round(p,4) difficulty_score FROM scored SEMI JOIN train USING (pairID)", "scored"),
    "ml9_difficulty_by_genre": _sql("""SELECT genre, round_even(avg(q),3) hard_ratio, sum(q)::bigint hard_count, count(*) total, round_even(avg(p),3) avg_score, round_even(stddev_samp(p),3) std_score, round_even(min(p),3) min_score, round_even(max(p),3) max_score
      FROM scored SEMI JOIN train USING (pairID) GROUP BY genre""", "scored"),
    "ml10_train_and_route": _sql(_savings("model_tiers"), "model_tiers"),
    "ml9_score_spread_by_genre": _sql("""SELECT genre, round_even(avg(pd),3) hard_ratio, sum(pd)::bigint hard_count, count(*) total, round_even(avg(difficulty_score),3) avg_score, round_even(stddev_samp(difficulty_score),3) std_score, round_even(min(difficulty_score),3) min_score, round_even(max(difficulty_score),3) max_score
      FROM (SELECT *, (difficulty_score > 0.5::double)::int pd FROM sc) GROUP BY genre""", "sc"),
    # streaming: the final state equals the batch result
    "str1_running_routing": _sql("SELECT routed_strategy, count(*) n, sum(est)::bigint tokens_spent, sum(greatest(0,500-est))::bigint tokens_saved FROM tiers GROUP BY ALL", "tiers"),
    "str2_running_usage": _sql("SELECT strategy, sum(prompt_tokens)::bigint prompt_tokens, sum(response_tokens)::bigint response_tokens, count(*) calls FROM preds GROUP BY ALL", "preds"),
    "str3_running_calls": _sql("SELECT CASE WHEN strategy LIKE '%cot' THEN 'gpt-4o' ELSE 'gpt-4o-mini' END model, count(*) FILTER (success) total_calls, sum(CASE WHEN success THEN prompt_tokens+response_tokens ELSE 0 END)::bigint total_tokens, count(*) FILTER (NOT success) errors FROM preds GROUP BY 1", "preds"),
    "str4_call_history": _sql("SELECT strategy, CASE WHEN length(premise) > 100 THEN substr(premise,1,100) || '...' ELSE premise END premise, CASE WHEN length(hypothesis) > 100 THEN substr(hypothesis,1,100) || '...' ELSE hypothesis END hypothesis, raw_response response, prompt_tokens, response_tokens FROM preds WHERE strategy IN ('zero-shot','cot')", "preds"),
    "str5_streaming_features": _sql(f"SELECT pairID, {', '.join(f'round({c},6) {c}' if c in ('length_ratio','jaccard_similarity','hypothesis_overlap','premise_coverage','lexical_overlap') else c for c in ALL)}, routed_strategy FROM routed", "routed"),
}

PATTERNS = """total_errors, n_valid, neutral_to_entailment, entailment_to_neutral, round(total_errors::double/n_valid,6) error_rate, round((neutral_to_entailment+entailment_to_neutral)::double/greatest(total_errors,1),6) neutral_entailment_rate
  FROM (SELECT {k}count(*) FILTER (label <> predicted_label) total_errors, count(predicted_label) n_valid, count(*) FILTER (label='neutral' AND predicted_label='entailment') neutral_to_entailment, count(*) FILTER (label='entailment' AND predicted_label='neutral') entailment_to_neutral FROM preds {g})"""
ORACLE["met10_confusion_patterns"] = _sql("SELECT " + PATTERNS.format(k="", g=""), "preds")
ORACLE["met12_patterns_by_strategy"] = _sql("SELECT strategy, " + PATTERNS.format(k="strategy, ", g="GROUP BY strategy"), "preds")

ROI = """SELECT n n_rows, atk::bigint adaptive_tokens, CASE WHEN ms IS NULL THEN 'fallback' ELSE 'measured' END baseline_source, round(n*coalesce(ms,500),9) baseline_tokens, round((n*coalesce(ms,500)-atk)/(n*coalesce(ms,500))*100,9) savings_pct, round((n*coalesce(ms,500)-atk)*0.0000003::double,9) savings_usd
  FROM (SELECT count(*) n, sum(prompt_tokens+response_tokens)::double atk, avg(prompt_tokens) FILTER (routed_strategy='6-shot') + avg(response_tokens) FILTER (routed_strategy='6-shot') ms FROM {r} r JOIN preds p USING (pairID) WHERE p.strategy = r.routed_strategy)"""
ORACLE["cst8_token_roi"] = _sql(ROI.format(r="routed"), "routed", "preds")
ORACLE["cst8_token_roi_fallback"] = _sql(ROI.format(r="routed_default"), "routed_default", "preds")


def _items_sql(items: str, body: str, *parts: str) -> str:
    text = _sql("", *parts).rstrip()
    return text + f",\n items AS ({items})," + _pareto("items") + "\n" + body


ORACLE["cst6_pareto"] = _items_sql(
    "SELECT pairID, strategy, prompt_tokens::double cost_usd, response_tokens::double accuracy FROM preds",
    "SELECT items.*, dom.c IS NULL pareto_optimal FROM items LEFT JOIN dom ON dom.c = cost_usd AND dom.v = accuracy", "preds")
ORACLE["jon6_undominated"] = _items_sql(
    "SELECT pairID, char_length::double cost_usd, hypothesis_length::double accuracy FROM feats",
    "SELECT items.* FROM items LEFT JOIN dom ON dom.c = cost_usd AND dom.v = accuracy WHERE dom.c IS NULL", "feats")
ORACLE["win4_running_best"] = _items_sql(
    "SELECT pairID, char_length::double cost_usd, shared_words::double accuracy FROM feats",
    "SELECT dom.c IS NULL pareto_optimal, count(*) n, sum(cost_usd) cost_total, max(accuracy) best FROM items LEFT JOIN dom ON dom.c = cost_usd AND dom.v = accuracy GROUP BY 1", "feats")
ORACLE["shp6_pareto_points"] = _sql("""SELECT strategy, round(accuracy,9) accuracy, round(cost_usd,9) cost_usd FROM cost_acc x WHERE NOT EXISTS
  (SELECT 1 FROM cost_acc y WHERE (y.accuracy > x.accuracy AND y.cost_usd <= x.cost_usd) OR (y.cost_usd < x.cost_usd AND y.accuracy >= x.accuracy))""", "cost_acc")
ORACLE["adaptive_summary"] = (_sql("", "clean") + "," + _features("clean", "cfeats") + "," + PARTS["preds"][1] + """,
 cr AS (SELECT *, CASE WHEN lower(genre) IN ('government','oup') THEN '6-shot-cot' WHEN char_length > 100 AND total_negations >= 1 AND lexical_overlap < 0.4 THEN '6-shot' ELSE 'zero-shot' END routed_strategy FROM cfeats)
 SELECT cr.genre, routed_strategy, count(*) n, round(count(*) FILTER (cr.label = predicted_label)::double/count(*),6) accuracy, sum(prompt_tokens+response_tokens)::bigint tokens_spent, (count(*)*500 - sum(prompt_tokens+response_tokens))::bigint tokens_saved
 FROM cr JOIN preds USING (pairID) WHERE preds.strategy = routed_strategy GROUP BY ALL""")
PARTS["adaptive_rows"] = (["cfeats", "preds"], """
 ar AS (SELECT cr.genre, cr.label, coalesce(p.predicted_label, 'none') predicted_label FROM (SELECT *, CASE WHEN lower(genre) IN ('government','oup') THEN '6-shot-cot'
   WHEN char_length > 100 AND total_negations >= 1 AND lexical_overlap < 0.4 THEN '6-shot' ELSE 'zero-shot' END routed_strategy FROM cfeats) cr JOIN preds p USING (pairID) WHERE p.strategy = cr.routed_strategy)""")
PARTS["m_ar"] = (["adaptive_rows"], _metrics("ar", ["genre"], "m_ar"))
ORACLE["adaptive_run"] = _sql(f"SELECT genre, {REPORT} FROM m_ar", "m_ar")
ORACLE["offline_savings"] = _sql("""SELECT nn n_rows, round(atk,6) adaptive_tokens, round(bt,6) baseline_tokens, round((bt-atk)*100/bt,6) savings_pct FROM (SELECT sum(n)::bigint nn, sum(n*t) atk, sum(n) * (SELECT avg(prompt_tokens)+avg(response_tokens) FROM preds WHERE strategy='cot') bt FROM
  (SELECT strategy, n, (SELECT avg(prompt_tokens)+avg(response_tokens) FROM preds p WHERE p.strategy = rcounts.strategy) t FROM rcounts))""", "rcounts", "preds")
