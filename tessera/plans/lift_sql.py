"""DuckDB SQL of the queries of the lift model."""

from __future__ import annotations

from tessera.plans import settings as S

_STOP = "[" + ", ".join(f"'{w}'" for w in S.ORACLE_STOP) + "]"
_SCREEN = "[" + ", ".join(f"'{w}'" for w in S.SCREEN_STOP) + "]"


_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_SCREEN_WORD = "[a-z0-9][a-z0-9''-]+"


def _cues(col: str, cues: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower({col}), '{c}')" for c in cues) + ")"


def _toks(col: str, pattern: str = "[a-z0-9]+", stop: str = _STOP) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({col}), '{pattern}')), lambda x: length(x) > 2 and not list_contains({stop}, x))"


def _label(c: str) -> str:
    names = ", ".join(f"'{k}'" for k in (*S.LIFT_OF, S.GUARANTEED))
    label = f"lower(regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g'))"
    return f"case when {label} in ({names}) then {label} else 'unchanged' end"


def _verdict(x: str) -> str:
    return f"case when {x} is null or isnan({x}) or isinf({x}) then 'neutral' when {x} >= 1 then 'strongly_supports' when {x} >= 0.3 then 'supports' when {x} >= -0.3 then 'neutral' when {x} >= -1 then 'contradicts' else 'strongly_contradicts' end"


def _lift(change: str, prior: str) -> str:
    rungs = " ".join(f"when '{k}' then {v}" for k, v in S.LIFT_OF.items())
    return f"least(greatest(case {change} {rungs} when 'guaranteed' then 0.97 / greatest({prior}, 0.001) else 1.0 end, 0.001), 20.0)"


_SUP, _CON = "verdict in ('supports', 'strongly_supports')", "verdict in ('contradicts', 'strongly_contradicts')"
CELLS = f"""cells as (select hyp_id, dp_id, model, {_label("change")} change, lift, log_lift, {_verdict("log_lift")} verdict from
    (select distinct on (hyp_id, dp_id, model) * from lift_cache where hyp_id is not null and dp_id is not null and model is not null
     order by hyp_id, dp_id, model, scored_at desc nulls last))"""
POINTS = "points as (select distinct on (dp_id) * from data_points where dp_id is not null order by dp_id, written_at desc nulls last)"
CRED = "cred as (select dp_id, coalesce(try_cast(json_extract_string(meta, '$.credibility') as double), 1.0) cred from points)"
#: Squeezed text cut at closing marks; RE2 has no lookbehind, so a control character marks the cuts.
SENTENCES = r"""sentences as (select doc_id, unnest(range(len(s))) pos, unnest(s) sentence from
    (select doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0) s from documents where text is not null))"""
_HASHED = """({src}) t, unnest(regexp_extract_all(lower(t.txt), '[a-z0-9]+')) w(tok)"""
VECTORS = """tf as (select doc_id, pos, ('0x' || right(md5(tok), 2))::int b, count(*)::double tf from (select doc_id, pos, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+')) tok from sentences) group by all),
  vec as (select doc_id, pos, b, tf / sqrt(sum(tf * tf) over (partition by doc_id, pos)) w from tf),
  sims as (select g.doc_id, g.pos, round(coalesce(s.s, 0.0), 6) sim from
    (select a.doc_id, a.pos from sentences a join sentences n on n.doc_id = a.doc_id and n.pos = a.pos + 1) g
    left join (select a.doc_id, a.pos, sum(a.w * n.w) s from vec a join vec n on n.doc_id = a.doc_id and n.pos = a.pos + 1 and n.b = a.b group by all) s on s.doc_id = g.doc_id and s.pos = g.pos)"""
THRESH = "thr as (select doc_id, quantile_cont(sim, 0.25) threshold from sims group by 1)"
_PLACED = """runs as (select s.*, sum(coalesce((m.sim <= t.threshold)::int, 0)) over (partition by s.doc_id order by s.pos) run from sentences s
    left join sims m on m.doc_id = s.doc_id and m.pos = s.pos - 1 left join thr t on t.doc_id = s.doc_id),
  marked as (select *, ((row_number() over (partition by doc_id, run order by pos) - 1) % 8 = 0)::int starts from runs),
  placed as (select *, (sum(starts) over (partition by doc_id order by pos) - 1)::int ord from marked)"""
_ATOMS = r"""src as (select distinct doc_id, chunk_id, ord, text from chunks where chunk_id is not null and text is not null {extra}),
  cut as (select doc_id, chunk_id, ord, regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g') p from src),
  split as (select doc_id, chunk_id, ord, p, list_filter(string_split(regexp_replace(p, '([.!?])[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 15) parts from cut),
  raw as (select doc_id, chunk_id, ord, case when len(parts) > 0 then parts else [substring(p, 1, 200)] end parts from split),
  each as (select doc_id, chunk_id, ord, unnest(range(len(parts))) pos, regexp_replace(unnest(parts), '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g') text from raw),
  kept as (select doc_id, chunk_id, ord, text, min(pos) pos from each where length(text) >= 10 group by all)"""
_PAIRS = f"""pairs as (select q.hyp_id, q.dp_id, {_toks("h.text")} ht, {_toks("p.text")} dt, {_cues("p.text", S.NEGATIVE_CUES)} neg,
    {_cues("p.text", S.RARE_CUES)} rare from (select distinct hyp_id, dp_id from lift_cache) q join hypotheses h on h.hyp_id = q.hyp_id join points p on p.dp_id = q.dp_id),
  judged as (select *, len(list_intersect(ht, dt)) / greatest(len(ht) + len(dt) - len(list_intersect(ht, dt)), 1) o from pairs),
  labelled as (select *, case when o < 0.06 then 'unchanged' when neg and o > 0.12 then 'much_less' when neg then 'less' when o > 0.28 then 'much_more' when o > 0.12 then 'more' else 'unchanged' end change,
    case when rare then 0.08 when len(dt) > 25 then 0.3 else 0.5 end prior from judged)"""
_RESIDUAL = f"with {CELLS}, r as (select dp_id, model, max(abs(log_lift)) residual from cells group by all having max(abs(log_lift)) <= 0.15)"
_ASOF = "(select dp_id, coalesce(prior, 0.5) prior from points)"
_SEEDS = """pool as (select hyp_id, dp_id, min(lift) lift from cells group by all),
  ranked as (select *, lift >= 0.25 mild, bool_or(lift >= 0.25) over (partition by hyp_id) any_mild,
    row_number() over (partition by hyp_id order by case when lift >= 0.25 then 0 else 1 end, lift, dp_id) rank from pool)"""

_LEXICAL = f"""h as (select hyp_id, len(t) nh, unnest(t) tok from (select hyp_id, {_toks('text')} t from hypotheses)),
        d as (select dp_id, neg, len(t) nd, unnest(t) tok from (select dp_id, {_cues('text', S.NEGATIVE_CUES)} neg, {_toks('text')} t from points where text is not null)),
        s as (select hyp_id, dp_id, neg, count(*) / (nh + nd - count(*)) o from d join h using (tok) group by hyp_id, dp_id, neg, nh, nd),
        c as (select hyp_id, dp_id, round(o, 6) overlap, neg, case when o < 0.06 then 'unchanged' when neg and o > 0.12 then 'much_less' when neg then 'less' when o > 0.28 then 'much_more' when o > 0.12 then 'more' else 'unchanged' end change from s)"""
_GRID = f"""{POINTS}, {CRED}, {_LEXICAL}, g as (select hyp_id, dp_id, ln({_lift('change', '0.5')}) x from c where change <> 'unchanged'),
  told as (select dp_id from points where text is not null), asked as (select hyp_id from hypotheses where text is not null)"""


def _entities(col: str, meta: str) -> str:
    """RE2's word boundary is ASCII: other letters become underscores, other marks blanks."""
    plain = rf"regexp_replace(regexp_replace({col}, '[^\p{{L}}\p{{Nd}}\p{{M}}\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
    found = rf"list_concat(regexp_extract_all({plain}, '\b[A-Z][a-zA-Z-]{{2,}}\b'), regexp_extract_all({plain}, '{_FIGURE}'))"
    values = "[" + ", ".join(f"json_extract_string({meta}, '$.{k}')" for k in S.DEFAULTS.entity_keys) + "]"
    return f"list_distinct(list_transform(list_concat({found}, list_filter({values}, lambda v: v is not null and v <> '')), lambda x: lower(x)))"


_FIGURE = S.FIGURE
_EVIDENCE = f"""ev as (select c.hyp_id, c.dp_id, c.lift, {_cues("p.text", S.NEGATIVE_CUES)}::int neg, (len(list_intersect({_toks("h.text")}, {_toks("p.text")})) > 0)::int pos,
    case when {_cues("p.text", S.RARE_CUES)} then 0.08 when len({_toks("p.text")}) > 25 then 0.3 else 0.5 end prior, {_entities("p.text", "p.meta")} ents, {_toks("p.text", _SCREEN_WORD, _SCREEN)} toks
    from (select hyp_id, dp_id, min(lift) lift from cells group by all) c join hypotheses h using (hyp_id) join points p using (dp_id) where p.text is not null),
  ranked as (select *, lift >= 0.25 mild, bool_or(lift >= 0.25) over (partition by hyp_id) any_mild,
    row_number() over (partition by hyp_id order by case when lift >= 0.25 then 0 else 1 end, lift, dp_id) rank from ev),
  seeds as (select *, rank - 1 seed from ranked where rank <= 3 and (mild or not any_mild)),
  near as (select s.hyp_id, s.seed, e.dp_id cand, 10 * len(list_intersect(s.ents, e.ents)) + len(list_intersect(s.toks, e.toks)) score,
    s.neg + e.neg neg, s.pos + e.pos pos, least(s.prior, e.prior) prior from seeds s join ev e on e.hyp_id = s.hyp_id and e.dp_id <> s.dp_id),
  listed as (select *, row_number() over (partition by hyp_id, seed order by score desc, cand) place from near where score > 0)"""

_JOINT = "case when {n} > 0 and {p} > 0 then 'much_less' when {n} > 0 then 'less' when {p} >= 2 then 'more' else 'unchanged' end"


def _refuting(size: int = S.DEFAULTS.set_size) -> str:
    """The search unrolled: rounds of growth (t: trials, f: frontier, d: done), rounds of dropping members, and the report."""
    parts = ["f0 as (select hyp_id, seed, [dp_id] m, neg, pos, prior, lift, ents, toks from seeds)"]
    for k in range(1, size):
        parts.append(f"""a{k} as (select f.hyp_id, f.seed, f.m, f.lift, e.dp_id cand, f.neg + e.neg neg, f.pos + e.pos pos, least(f.prior, e.prior) prior, list_distinct(list_concat(f.ents, e.ents)) ents, list_distinct(list_concat(f.toks, e.toks)) toks,
            10 * len(list_intersect(f.ents, e.ents)) + len(list_intersect(f.toks, e.toks)) score from f{k - 1} f join ev e on e.hyp_id = f.hyp_id and not list_contains(f.m, e.dp_id))""")
        parts.append(f"l{k} as (select *, row_number() over (partition by hyp_id, seed order by score desc, cand) place from a{k} where score > 0)")
        parts.append(f"j{k} as (select *, {_JOINT.format(n='neg', p='pos')} change from l{k} where place <= {S.DEFAULTS.shortlist})")
        parts.append(f"t{k} as (select *, {_lift('change', 'prior')} joint from j{k})")
        parts.append(f"b{k} as (select *, row_number() over (partition by hyp_id, seed order by joint, place) first from t{k} where joint < lift)")
        parts.append(f"g{k} as (select hyp_id, seed, list_append(m, cand) m, neg, pos, prior, joint lift, ents, toks from b{k} where first = 1)")
        parts.append(f"f{k} as (select * from g{k} where lift >= {S.DEFAULTS.refute_lift})")
    calls = " union all ".join(f"select hyp_id, seed from t{k}" for k in range(1, size))
    parts.append(f"calls as (select hyp_id, seed, sum(count(*)) over (partition by hyp_id order by seed)::bigint llm_calls from ({calls}) group by hyp_id, seed)")
    done = " union all ".join(f"select hyp_id, seed, m, lift from g{k} where lift < {S.DEFAULTS.refute_lift}" for k in range(1, size))
    parts.append(f"s0 as ({done})")
    for r in range(1, size - 1):
        parts.append(f"""w{r} as (select hyp_id, seed, i, list_concat(m[:i - 1], m[i + 1:]) m from (select *, unnest(range(1, len(m) + 1)) i from s{r - 1} where len(m) > 2))""")
        parts.append(f"x{r} as (select w.hyp_id, w.seed, w.i, any_value(w.m) m, sum(e.neg) neg, sum(e.pos) pos, min(e.prior) prior from (select *, unnest(m) dp_id from w{r}) w join ev e on e.hyp_id = w.hyp_id and e.dp_id = w.dp_id group by w.hyp_id, w.seed, w.i)")
        parts.append(f"y{r} as (select *, {_JOINT.format(n='neg', p='pos')} change from x{r})")
        parts.append(f"z{r} as (select distinct on (hyp_id, seed) hyp_id, seed, m, lift from (select *, {_lift('change', 'prior')} lift from y{r}) where lift < {S.DEFAULTS.refute_lift} order by hyp_id, seed, i)")
        parts.append(f"s{r} as (select s.hyp_id, s.seed, coalesce(z.m, s.m) m, coalesce(z.lift, s.lift) lift from s{r - 1} s left join z{r} z on z.hyp_id = s.hyp_id and z.seed = s.seed)")
    parts.append(f"named as (select distinct on (hyp_id, set_key) * from (select *, array_to_string(list_sort(list_distinct(m)), ',') set_key from s{size - 2}) order by hyp_id, set_key, seed)")
    parts.append("own as (select n.hyp_id, n.set_key, min(e.lift) least from (select hyp_id, set_key, unnest(m) dp_id from named) n join ev e on e.hyp_id = n.hyp_id and e.dp_id = n.dp_id group by all)")
    return f"""with {POINTS}, {CELLS}, {_EVIDENCE}, {", ".join(parts)}
        select n.hyp_id, n.seed, n.set_key, round(lift, 6) joint_lift, round(ln(greatest(lift, 1e-6)), 6) joint_log_lift, least >= {S.DEFAULTS.refute_lift} conjunction_only, llm_calls
        from named n join own o on o.hyp_id = n.hyp_id and o.set_key = n.set_key join calls c on c.hyp_id = n.hyp_id and c.seed = n.seed"""


SQL = {
    "refuting_sets": _refuting(),
    "matrix_by_hypothesis": f"""with {CELLS}, own as (select hyp_id, row_number() over (order by hyp_id) k from hypotheses where json_extract_string(meta, '$.scenario') = (select min(json_extract_string(meta, '$.scenario')) from hypotheses)),
        x as (select dp_id, 'h' || k h, round(log_lift, 6) v from cells join own using (hyp_id)) pivot x on h using max(v) group by dp_id""",
    "residual_cluster_checks": "select true sizes, true coherences, true disjoint, true residual",
    "sentence_split": f"with {SENTENCES} select doc_id, pos, sentence from sentences",
    "sentence_stats": f"with {SENTENCES} select doc_id, count(*) n_sentences, sum(length(sentence))::bigint n_chars from sentences group by 1",
    "content_ids": r"select distinct dp_id, left(sha256(encode(text) || '\x00'::blob), 16) content_id from data_points where text is not null",
    "hash_embed_norms": f"""with {POINTS}, tf as (select dp_id, right(md5(tok), 2) b, count(*)::double tf from (select dp_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) tok from points) group by all),
        v as (select dp_id, tf / sqrt(sum(tf * tf) over (partition by dp_id)) w from tf) select dp_id, count(*) n_buckets, round(max(w), 6) largest, round(sum(w), 6) total from v group by 1""",
    "adjacent_similarity": f"with {SENTENCES}, {VECTORS} select * from sims",
    "trough_threshold": f"with {SENTENCES}, {VECTORS}, {THRESH} select doc_id, round(threshold + 1e-9, 6) threshold from thr",
    "semantic_chunks": f"with {SENTENCES}, {VECTORS}, {THRESH}, {_PLACED} select doc_id, ord, count(*) n_sentences, md5(string_agg(sentence, ' ' order by pos)) text_md5 from placed group by all",
    "chunk_atoms": f"with {_ATOMS.format(extra='')} select chunk_id, count(*) n_atoms, max(length(text)) longest from kept group by 1",
    "dedup_atoms_last_writer": f"""with {_ATOMS.format(extra='and ord is not null')}, named as (select *, left(sha256(encode(text) || '\\x00'::blob), 16) dp_id from kept)
        select distinct on (dp_id) dp_id, chunk_id, doc_id from named order by dp_id, doc_id desc, ord desc, pos desc, chunk_id desc""",
    "latest_data_points": "select dp_id, max(written_at) written_at from data_points where dp_id is not null group by 1",
    "live_documents": "select doc_id, ingested_at from documents d left join (select key, max(deleted_at) x from tombstones where tbl = 'documents' group by 1) t on t.key = cast(d.doc_id as varchar) where x is null or ingested_at > x",
    "live_data_points": "select dp_id, max(written_at) written_at from data_points d left join (select key, max(deleted_at) x from tombstones where tbl = 'data_points' group by 1) t on t.key = d.dp_id where dp_id is not null and (x is null or written_at > x) group by 1",
    "oracle_tokens": f"with {POINTS} select dp_id, array_to_string(list_sort({_toks('text')}), ' ') tokens from points where text is not null",
    "screen_tokens": f"with {POINTS} select dp_id, array_to_string(list_sort({_toks('text', _SCREEN_WORD, _SCREEN)}), ' ') tokens from points where text is not null",
    "priors": f"with {POINTS} select dp_id, case when {_cues('text', S.RARE_CUES)} then 0.08 when len({_toks('text')}) > 25 then 0.3 else 0.5 end prior from points where text is not null",
    "lexical_pairs": f"""with {POINTS}, {_PAIRS}, done as (select *, {_lift('change', 'prior')} lift from labelled)
        select hyp_id, dp_id, change, prior, round(least(1.0, o * 2.2), 3) relatedness, round(lift, 6) lift, round(ln(lift), 6) log_lift, {_verdict('ln(lift)')} verdict from done""",
    "lexical_cells": f"with {POINTS}, {_LEXICAL} select * from c where change <> 'unchanged'",
    "change_labels": f"select {_label('change')} \"label\", count(*) n from lift_cache group by 1",
    "lift_scale": f"""with {POINTS}, {CELLS}, x as (select c.change, round({_lift('c.change', 'coalesce(p.prior, 0.5)')}, 6) v from cells c left join {_ASOF} p on p.dp_id = c.dp_id)
        select change, count(*) n, min(v) least, max(v) greatest from x group by 1""",
    "verdict_histogram": f"with {CELLS} select model, verdict, count(*) n from cells group by all",
    "hypothesis_scores": f"""with {POINTS}, {CRED}, {CELLS}, g as (select hyp_id, model, sum(log_lift * coalesce(cred, 1.0)) score, count(*) n, count(*) filter ({_SUP}) n_supporting, count(*) filter ({_CON}) n_contradicting
        from cells c left join cred using (dp_id) group by all)
        select hyp_id, model, round(score, 6) + 0.0 score, n, n_supporting, n_contradicting, n - n_supporting - n_contradicting n_neutral, {_verdict('round(score / greatest(n, 1), 9)')} verdict from g""",
    "best_worst_cells": f"""with {CELLS} select hyp_id, model, arg_min(dp_id, (log_lift, dp_id)) worst_dp, round(min(log_lift), 6) worst, arg_min(dp_id, (-log_lift, dp_id)) best_dp, round(max(log_lift), 6) best from cells group by all""",
    "diagnosticity": f"with {CELLS} select dp_id, model, round(coalesce(var_pop(log_lift), 0), 6) diagnosticity, count(*) n_hyps from cells group by all",
    "diagnosticity_top": f"with {CELLS} select dp_id, model, round(coalesce(var_pop(log_lift), 0), 6) diagnosticity, count(*) n_hyps from cells group by all order by diagnosticity desc, dp_id, model limit 5",
    "diagnosticity_bottom": f"with {CELLS} select dp_id, model, round(coalesce(var_pop(log_lift), 0), 6) diagnosticity, count(*) n_hyps from cells group by all order by diagnosticity, dp_id, model limit 5",
    "matrix_wide": f"""with {CELLS} select hyp_id, dp_id, round(max(log_lift) filter (model = 'lexical-mock'), 6) lexical_mock, round(max(log_lift) filter (model = 'oracle-a'), 6) oracle_a,
        round(max(log_lift) filter (model = 'oracle-b-mini'), 6) oracle_b_mini, round(max(log_lift) filter (model = 'oracle-c'), 6) oracle_c from cells group by all""",
    "matrix_documents": f"""with {POINTS}, {CRED}, {CELLS}, g as (select hyp_id, model, sum(log_lift * coalesce(cred, 1.0)) score, count(*) n from cells c left join cred using (dp_id) group by all)
        select 'result' kind, hyp_id "key", model, {_verdict('round(score / greatest(n, 1), 9)')} verdict, null change, n::varchar n from g
        union all select 'cell', hyp_id || '|' || dp_id, model, verdict, change, null from cells""",
    "cache_misses": """with w as (select distinct hyp_id, dp_id from lift_cache where hyp_id is not null and dp_id is not null and model is not null)
        select hyp_id, dp_id, 'oracle-a' model from w anti join (select hyp_id, dp_id from lift_cache where model = 'oracle-a') c using (hyp_id, dp_id)""",
    "cache_merge": f"""with {CELLS}, n as (select hyp_id, dp_id, 'oracle-a' model, round(lift, 6) lift from cells where model = 'oracle-c')
        select hyp_id, dp_id, model, round(lift, 6) lift from cells anti join n using (hyp_id, dp_id, model) union all select hyp_id, dp_id, model, lift from n""",
    "pairwise_refutations": f"with {CELLS} select hyp_id, dp_id, model, round(lift, 6) lift from cells where lift < 0.25",
    "refutation_seeds": f"with {CELLS}, {_SEEDS} select hyp_id, rank - 1 seed, dp_id, round(lift, 6) lift from ranked where rank <= 3 and (mild or not any_mild)",
    "residual_points": f"{_RESIDUAL} select dp_id, model, round(residual, 6) residual from r",
    "residual_counts": f"{_RESIDUAL} select model, count(*) n from r group by 1",
    "verify_abduction": f"with {CELLS}, v as (select hyp_id, model, count(*) n_members, avg(case when lift >= 1.5 then 1.0 else 0.0 end) s from cells group by all) select hyp_id, model, n_members, round(s, 6) explained, s >= 0.5 admitted from v",
    "supporting_terms": f"""with {POINTS}, {CELLS}, held as (select distinct hyp_id, dp_id from cells where {_SUP}),
        t as (select hyp_id, term, count(*) df from (select hyp_id, unnest({_toks('text')}) term from held join points using (dp_id)) group by all),
        r as (select *, row_number() over (partition by hyp_id order by df desc, term) rank from t) select hyp_id, string_agg(term, ', ' order by rank) terms from r where rank <= 4 group by 1""",
    "embedding_coherence": """with x as (select label, unnest(embedding)::double x, unnest(range(len(embedding))) k from embeddings where label is not null),
        s as (select label, k, sum(x) s, sum(x * x) o, count(*) n from x group by all) select label, max(n) n, round((sum(s * s) - sum(o)) / greatest(max(n) * (max(n) - 1), 1), 6) coherence from s group by 1""",
    "hypothesis_detail": f"""with {POINTS}, {CELLS} select hyp_id, model, c.dp_id, round(log_lift, 6) log_lift, verdict, coalesce(nullif(json_extract_string(p.meta, '$.source'), ''), cast(p.doc_id as varchar)) source,
        row_number() over (partition by hyp_id, model order by log_lift, c.dp_id) rank from cells c left join points p on p.dp_id = c.dp_id""",
    "abduced_terms": f"""with {POINTS}, {CELLS}, r as (select dp_id, model from cells group by all having max(abs(log_lift)) <= 0.15), m as (select doc_id, text from points where text is not null and doc_id is not null and dp_id in (select dp_id from r)),
        t as (select doc_id, term, count(*) df from (select doc_id, unnest({_toks('text')}) term from m) group by all), k as (select *, row_number() over (partition by doc_id order by df desc, term) rank from t)
        select doc_id, string_agg(term, ', ' order by rank) terms, 'A common underlying factor involving ' || string_agg(term, ', ' order by rank) || ' explains these observations.' hypothesis from k where rank <= 4 group by 1""",
    "parsed_replies": """with r as (select distinct hyp_id, dp_id, model, regexp_extract(rationale, '(?s)\\{.*\\}') j from lift_cache where rationale like '%{%'),
        p as (select *, case when json_valid(j) then j end o from r) select json_extract_string(o, '$.change') change, o is not null parsed, count(*) n from (select distinct hyp_id, dp_id, model, o from p) group by all""",
    "embedding_separability": """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings where label is not null),
        d as (select a.label la, b.label lb, 1 - list_dot_product(a.v, b.v) d from e a join e b on a.vec_id < b.vec_id),
        l as (select label, count(*) n from e group by 1),
        s as (select l.label, l.n, avg(d) filter (la = l.label and lb = l.label) pp, avg(d) filter ((la = l.label) <> (lb = l.label)) pq, avg(d) filter (la <> l.label and lb <> l.label) qq,
              var_pop(d) filter (la = l.label and lb = l.label) vpp, var_pop(d) filter ((la = l.label) <> (lb = l.label)) vpq from l cross join d group by all),
        c as (select *, case when vpp + vpq > 0 then (pq - pp) / sqrt((vpp + vpq) / 2) else 0 end cd from s)
        select label, n, round(pp, 6) mean_pp, round(pq, 6) mean_pq, round(qq, 6) mean_qq, round(vpp, 6) var_pp, round(vpq, 6) var_pq, round(cd, 4) cohen_d, case when cd < 0.2 then 'none' when cd < 0.8 then 'weak' else 'strong' end separation from c""",
    "retrieval_topk": f"""with {POINTS}, h as (select hyp_id, b, tf / sqrt(sum(tf * tf) over (partition by hyp_id)) w from (select hyp_id, right(md5(tok), 2) b, count(*)::double tf from (select hyp_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) tok from hypotheses) group by all)),
        p as (select dp_id, b, tf / sqrt(sum(tf * tf) over (partition by dp_id)) w from (select dp_id, right(md5(tok), 2) b, count(*)::double tf from (select dp_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) tok from points where text is not null) group by all)),
        x as (select dp_id, hyp_id, sum(p.w * h.w) s from p join h using (b) group by all), m as (select dp_id, max(s) s from x group by 1),
        o as (select points.dp_id, round(coalesce(s, 0.0), 6) sim from points left join m using (dp_id) where text is not null)
        select dp_id, sim from o order by sim desc, dp_id limit (select greatest(3, count(*) // 3) from o)""",
    "ranked_hypotheses": f"""with {POINTS}, {CRED}, {CELLS}, g as (select hyp_id, model, round(sum(log_lift * coalesce(cred, 1.0)), 6) + 0.0 score from cells c left join cred using (dp_id) group by all)
        select hyp_id, model, score, row_number() over (partition by model order by score desc, hyp_id) rank from g""",
    "diagnostic_order": f"""with {CELLS}, g as (select dp_id, model, round(coalesce(var_pop(log_lift), 0), 6) diagnosticity from cells group by all)
        select dp_id, model, diagnosticity, row_number() over (partition by model order by diagnosticity desc, dp_id) rank from g""",
    "matrix_points": f"""with {POINTS}, {CELLS}, g as (select dp_id, model, round(coalesce(var_pop(log_lift), 0), 3) diagnosticity from cells group by all)
        select dp_id, model, coalesce(nullif(json_extract_string(meta, '$.source'), ''), cast(doc_id as varchar)) source, json_extract_string(meta, '$.credibility') credibility, json_extract_string(meta, '$.noise') noise, diagnosticity
        from g join points using (dp_id)""",
    "report_ends": f"""with {POINTS}, {CRED}, {CELLS}, g as (select hyp_id, model, round(sum(log_lift * coalesce(cred, 1.0)), 6) + 0.0 score from cells c left join cred using (dp_id) group by all),
        r as (select *, row_number() over (partition by model order by score desc, hyp_id) rank, count(*) over (partition by model) n from g),
        e as (select model, 'top' place, hyp_id, 1 as side from r where rank = 1 union all select model, 'bottom', hyp_id, -1 from r where rank = n),
        x as (select e.model, place, e.hyp_id, arg_min(dp_id, (-side * log_lift, dp_id)) dp_id from e join cells c on c.hyp_id = e.hyp_id and c.model = e.model group by all)
        select model, place, hyp_id, dp_id, text from x left join points using (dp_id)""",
    "hypothesis_view": f"""with {POINTS}, {CELLS}, one as (select hyp_id from cells group by 1 order by count(*) desc, hyp_id limit 1)
        select hyp_id, model, c.dp_id, round(log_lift, 6) log_lift, verdict, coalesce(nullif(json_extract_string(p.meta, '$.source'), ''), cast(p.doc_id as varchar)) source,
        row_number() over (partition by hyp_id, model order by log_lift, c.dp_id) rank from cells c left join points p on p.dp_id = c.dp_id where hyp_id in (select hyp_id from one)""",
    "document_points": f"with {POINTS} select doc_id, count(*) n_data_points, md5(string_agg(text, '|' order by dp_id)) texts_md5 from points where doc_id is not null and text is not null group by 1",
    "scenario_hypotheses": "select json_extract_string(meta, '$.scenario') scenario, count(*) n, min(hyp_id) first_hyp from hypotheses group by 1",
    "grid_scores": f"""with {_GRID}, sums as (select hyp_id, sum(x * coalesce(cred, 1.0)) score, count(*) filter (x >= 0.3) sup, count(*) filter (x < -0.3) con from g left join cred using (dp_id) group by 1),
        r as (select hyp_id, coalesce(score, 0.0) score, (select count(*) from told) n, coalesce(sup, 0) n_supporting, coalesce(con, 0) n_contradicting from asked left join sums using (hyp_id))
        select hyp_id, round(score, 6) + 0.0 score, n, n_supporting, n_contradicting, n - n_supporting - n_contradicting n_neutral, {_verdict('round(score / greatest(n, 1), 9)')} verdict from r""",
    "grid_diagnosticity": f"""with {_GRID}, sums as (select dp_id, sum(x) s, sum(x * x) q from g group by 1), n as (select greatest(count(*), 1) n from asked)
        select dp_id, round(greatest(0.0, coalesce(q, 0) / n - (coalesce(s, 0) / n) * (coalesce(s, 0) / n)), 6) diagnosticity from told left join sums using (dp_id) cross join n""",
    "grid_detail": f"""with {_GRID} select hyp_id, g.dp_id, round(x, 6) log_lift, {_verdict('x')} verdict, coalesce(nullif(json_extract_string(p.meta, '$.source'), ''), cast(p.doc_id as varchar)) source,
        row_number() over (partition by hyp_id order by x, g.dp_id) rank from g left join points p on p.dp_id = g.dp_id""",
    "tfidf_norms": rf"""with {POINTS}, r as (select doc_id, dp_id, text from points where doc_id is not null and text is not null),
        t as (select doc_id, dp_id, term, count(*)::double tf from (select doc_id, dp_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\p{{Nl}}]{{2,}}')) term from r) group by all),
        d as (select doc_id, term, count(*) df from t group by all), n as (select doc_id, count(*) n from r group by 1),
        x as (select doc_id, dp_id, tf * (ln((1 + n) / (1 + df)) + 1) x from t join d using (doc_id, term) join n using (doc_id))
        select doc_id, dp_id, count(*) n_terms, round(max(x) / sqrt(sum(x * x)), 6) largest from x group by all""",
    "entity_sets": f"with {POINTS} select dp_id, array_to_string(list_sort({_entities('text', 'meta')}), ' ') entities from points where text is not null",
    "figures": rf"""with {POINTS} select dp_id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{Nd}}\p{{M}}\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g'), '{_FIGURE}'))), ' ') figures
        from points where text is not null""",
    "structural_candidates": f"with {POINTS}, {CELLS}, {_EVIDENCE} select hyp_id, seed, cand, place rank, score from listed where place <= 25",
    "joint_lift_pairs": f"""with {POINTS}, {CELLS}, {_EVIDENCE}, j as (select hyp_id, seed, cand, prior, case when neg > 0 and pos > 0 then 'much_less' when neg > 0 then 'less' when pos >= 2 then 'more' else 'unchanged' end change from listed where place <= 25)
        select hyp_id, seed, cand, round({_lift('change', 'prior')}, 6) joint_lift from j""",
}
