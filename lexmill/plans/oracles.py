"""Equivalent SQL for the registered queries, in DuckDB's dialect, over the same tables."""

from __future__ import annotations

# RE2 spellings of the character classes.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"


def swap(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def no_html(t):
    return swap(t, "<[^>]+>", " ")


def no_urls(t):
    return swap(t, rf"http[^{SPACE}]+|www\.[^{SPACE}]+", " ")


def no_emails(t):
    return swap(t, rf"[^{SPACE}]+@[^{SPACE}]+", " ")


def no_marks(t):
    return swap(t, rf"[@#]([{WORD}]+)", r"\1")


def one_space(t):
    return f"trim({swap(t, f'[{SPACE}]+', ' ')})"


def clean(t):
    return one_space(no_marks(no_emails(no_urls(no_html(f"coalesce({t}, '')")))))


def words(t):
    return f"regexp_extract_all({t}, '[{WORD}]{{2,}}')"


def grams(n: int = 2) -> str:
    """All n-grams up to ``n`` of the list column ``w``."""
    parts = ["w"]
    for size in range(2, n + 1):
        joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
        parts.append(f"list_transform(range(1, len(w) - {size - 2}), lambda i: {joined})")
    out = parts[0]
    for part in parts[1:]:
        out = f"list_concat({out}, {part})"
    return out


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::double / nullif({b}, 0), 0.0)"


def tenth(x: str) -> str:
    return f"printf('%.1f', {x})::double"


LABELLED = "labelled as (select d.doc_id, d.lang, l.quality as label, l.toxic from documents d join labels l using (doc_id))"
CORPUS = "corpus as (select d.doc_id, d.lang, d.text, l.quality as label from documents d join labels l using (doc_id))"
CLEAN_DOCS = f"docs as (select * from (select doc_id, lang, {clean('text')} as text from documents) where text <> '')"
CLEAN_CORPUS = f"{CORPUS}, docs as (select * from (select doc_id, lang, label, {clean('text')} as text from corpus) where text <> '')"
SCORE = "(('0x' || substr(md5(doc_id::varchar), 1, 6))::bigint / 16777216.0::double)"


def scored(source: str, columns: str) -> str:
    return (
        f"raw as (select {columns}, {SCORE} as score from {source}), "
        "scored as (select *, (score > 0.5)::int as pred, greatest(score, 1 - score) as confidence from raw)"
    )


SCORED = f"{LABELLED}, {scored('labelled', 'doc_id, lang, label')}"

RAW_STRING = "(['Positive', ' neg ', 'neutral', '5', 'junk', 'GOOD', 'bad', '0', '1'])[doc_id % 9 + 1]"
STRING_LABEL = (
    "case when k in ('positive', 'pos', '1', 'good') then 1 when k in ('negative', 'neg', '0', 'bad') then 0 "
    "when k = 'neutral' then null else try_cast(k as int) end"
)


def shares(source: str, group: str, size: str, total: str, want: str, out: str, lone: str) -> str:
    """Largest-remainder shares of ``want`` for the classes of each group."""
    part = f"partition by {group}" if group else ""
    return f"""select * exclude (base_, rem_, extra_, place_), base_ + (place_ <= extra_)::int as {out} from (
      select *, {want} - sum(base_) over ({part}) as extra_,
             row_number() over ({part} order by (n < 2)::int {lone}, rem_ desc, label) as place_
      from (select *, ({size} * {want}) // {total} as base_, ({size} * {want}) % {total} as rem_ from {source}))"""


def holdout(source: str, group: str = "") -> str:
    by = f"{group}, label" if group else "label"
    part = f"partition by {group}" if group else ""
    return f"""sizes as (select {by}, count(*)::bigint as n from {source} group by all),
    wanted as (select *, (sum(n) over ({part}))::bigint as total_, ceil(0.05::double * (sum(n) over ({part})))::bigint as want_ from sizes),
    quota as ({shares('wanted', group, 'n', 'total_', 'want_', 'k', 'asc')}),
    ranked as (select *, row_number() over (partition by {by} order by md5('42|' || doc_id), doc_id) as r_ from {source}),
    split as (select s.* exclude (r_), case when s.r_ <= q.k then 'val' else 'train' end as split from ranked s join quota q using ({by}))"""


def threeway(source: str, group: str = "") -> str:
    by = f"{group}, label" if group else "label"
    part = f"partition by {group}" if group else ""
    return f"""sizes as (select {by}, count(*)::bigint as n from {source} group by all),
    wanted as (select *, (sum(n) over ({part}))::bigint as total_, floor(0.8::double * (sum(n) over ({part})))::bigint as want_ from sizes),
    q1 as ({shares('wanted', group, 'n', 'total_', 'want_', 'train_', 'desc')}),
    q2 as (select *, n - train_ as left_, greatest(total_ - want_, 1) as rest_, floor(0.5::double * (total_ - want_))::bigint as wval_ from q1),
    quota as ({shares('q2', group, 'left_', 'rest_', 'wval_', 'val_', 'asc')}),
    ranked as (select *, row_number() over (partition by {by} order by md5('42|' || doc_id), doc_id) as r_ from {source}),
    split as (select s.* exclude (r_), case when s.r_ <= q.train_ then 'train' when s.r_ <= q.train_ + q.val_ then 'val' else 'test' end as split
              from ranked s join quota q using ({by}))"""


SPLIT = f"{LABELLED}, {threeway('labelled', 'lang')}"
RECORDS = f"""{CORPUS}, quoted as (select doc_id, text, label, '"' || replace(text, '"', '""') || '"' as q from corpus),
  records as (select doc_id, text, label, case doc_id % 10 when 0 then q || ',abc' when 1 then q when 2 then q || ',' || label || ',9' else q || ',' || label end as record from quoted)"""
MODES = "(values ('zero_shot', ['en']), ('low_resource', ['de']), ('combined', ['en', 'de'])) m(mode, langs)"

CELLS = """cells as (select {by} count_if(label = 0 and pred = 0) as tn, count_if(label = 0 and pred = 1) as fp,
    count_if(label = 1 and pred = 0) as fn, count_if(label = 1 and pred = 1) as tp from scored {group})"""
CELLS_LANG = CELLS.format(by="lang,", group="group by lang")
CELLS_ALL = CELLS.format(by="", group="")
CLASSES = f"""classes as (
    select *, 0 as cls, 'negative' as class, {ratio('tn', 'tn + fn')} as precision, {ratio('tn', 'tn + fp')} as recall,
           {ratio('2 * tn', '2 * tn + fp + fn')} as f1, tn + fp as support, tn + fp + fn > 0 as present from cells
    union all by name
    select *, 1 as cls, 'positive' as class, {ratio('tp', 'tp + fp')} as precision, {ratio('tp', 'tp + fn')} as recall,
           {ratio('2 * tp', '2 * tp + fp + fn')} as f1, tp + fn as support, tp + fp + fn > 0 as present from cells)"""
SUMMARY = f"""select lang, any_value(tn + fp + fn + tp)::bigint as n, {r6('any_value((tn + tp) / (tn + fp + fn + tp))')} as accuracy,
    {r6('avg(precision) filter (where present)')} as precision, {r6('avg(recall) filter (where present)')} as recall,
    {r6('avg(f1) filter (where present)')} as f1 from classes group by lang"""
BUCKETED = """bucketed as (select unnest(list_filter([
      case when pred = 1 and label = 0 then 'false_positives' end, case when pred = 0 and label = 1 then 'false_negatives' end,
      case when pred <> label and confidence > 0.9 then 'high_confidence_wrong' end,
      case when pred = label and confidence < 0.6 then 'low_confidence_correct' end], lambda b: b is not null)) as bucket, * from scored)"""


def phrase(s: str) -> str:
    return f"case when {s} > 0.9 then 'very high confidence' when {s} > 0.7 then 'high confidence' when {s} > 0.5 then 'moderate confidence' else 'low confidence' end"


EMOJI = (
    "case when pred = 1 then case when confidence > 0.9 then '😄' when confidence > 0.7 then '🙂' else '😐' end "
    "else case when confidence > 0.9 then '😢' when confidence > 0.7 then '😕' else '😐' end end"
)
NAME = "case when {} = 1 then 'positive' else 'negative' end"

TERMS = f"t as (select doc_id, lang, unnest({grams()}) as term from (select doc_id, lang, {words('text')} as w from docs)), tc as (select doc_id, lang, term, count(*) as c from t group by all)"
STATS = "st as (select term, sum(c)::bigint as tf, count(*) as df from tc group by term)"
VOCAB = f"{CLEAN_DOCS}, {TERMS}, {STATS}, top as (select * from st order by tf desc, term limit 50000), nd as (select count(*) as n_docs from docs), " \
    "vocab as (select top.*, row_number() over (order by term) - 1 as idx, ln((1 + n_docs) / (1 + df)::double) + 1 as idf from top, nd)"
WEIGHTS = "w as (select tc.doc_id, tc.lang, tc.term, v.idx, (1 + ln(tc.c)) * v.idf as w from tc join vocab v using (term))"
TFIDF = f"with {VOCAB}, {WEIGHTS} select doc_id, term, {r6('w / sqrt(sum(w * w) over (partition by doc_id))')} as weight from w"

KNOWN = f"""{VOCAB}, {WEIGHTS}, c as (select doc_id, w, w * (('0x' || substr(md5('SEED' || term), 1, 6))::bigint / 16777216.0::double - 0.5) as wc from w),
    z as (select docs.doc_id, coalesce(sum(wc) / sqrt(sum(w * w)), 0.0) + 0.01::double as z from docs left join c using (doc_id) group by docs.doc_id),
    p as (select doc_id, z, 1 / (1 + exp(-z)) as p from z)"""
KNOWN_SCORED = f"""{KNOWN}, {LABELLED}, scored as (select l.doc_id, l.lang, l.label, (z > 0)::int as pred, p as score, greatest(p, 1 - p) as confidence
    from labelled l join p using (doc_id))"""


def known(query: str, seed: str = "") -> str:
    return f"with {KNOWN_SCORED.replace('SEED', seed)}, {query}"


SIZE = "([100, 250, 500, 1000, 2500, 9681])[user_id % 6 + 1]"
EVENT = "day(ts) % 3 + 42 as seed, case when event_id % 2 = 0 then 'en' else 'de' end as lang, round(value * 100)::bigint as cents, value"
FIGURES = "count(*) as n, sum(cents) / (count(cents) * 10000.0::double) as f1, count_if(value > 10) / count(*) as accuracy"
RUNS = f"runs as (select condition, size, seed, lang, {FIGURES} from (select event_type as condition, {SIZE} as size, {EVENT} from events) group by all)"
MODE_RUNS = f"runs as (select *, n * seed as train_samples from (select mode, seed, lang, {FIGURES} from (select event_type as mode, {EVENT} from events) group by all))"
LOG = "log as (select event_type as run, day(ts) as epoch, sum(round(value * 100)::bigint) / (count(value) * 100.0::double) as score from events group by all)"
STD = "coalesce(stddev_samp({}), 0.0)"
BY_SIZE = f"{RUNS}, s as (select condition, size, avg(f1) as mean, {STD.format('f1')} as std from runs where lang = 'de' group by all)"
PLAN = f"""{SPLIT}, avail as (select count(*) as a from split where split = 'train' and lang = 'en'),
  plan as (select condition, size, seed, least(size::bigint, a) as examples from avail, (select unnest(['target_only', 'source_first']) as condition),
    (select unnest([100, 250, 500, 1000, 2500, 9681]) as size), (select unnest([42, 43, 44]) as seed) where a > 0),
  planned as (select *, greatest(4, ceil(200.0 / ceil(examples / 16)))::bigint as epochs from plan),
  full_plan as (select *, (epochs * ceil(examples / 16))::bigint as steps from planned)"""


def cell(mean: str, std: str, runs: str) -> str:
    return f"case when {mean} is null then '-' when {runs} > 1 then printf('%.1f', 100 * {mean}) || ' ± ' || printf('%.1f', 100 * {std}) else printf('%.1f', 100 * {mean}) end"


def nested(columns: str) -> str:
    return f"""{LABELLED}, ranked as (select {columns}, seed, row_number() over (partition by seed order by md5(seed || '|' || doc_id), doc_id) as r
      from labelled, (select unnest([42, 43, 44]) as seed)),
    subsets as (select ranked.*, size from ranked join (select unnest([10, 25, 50, 100]::bigint[]) as size) on r <= size)"""


def early(sql_scores: str, patience: int, delta: float) -> str:
    """Stopping written as a walk over the epochs of every run."""
    return f"""with recursive {LOG}, o as (select run, epoch, {sql_scores} as score, row_number() over (partition by run order by epoch) as i from log),
    walk as (select run, i, score as best, 0 as waited, null::bigint as stop from o where i = 1
      union all
      select o.run, o.i, case when o.score > w.best + {delta}::double then o.score else w.best end,
        case when o.score > w.best + {delta}::double then 0 else w.waited + 1 end,
        case when w.stop is null and o.score <= w.best + {delta}::double and w.waited + 1 >= {patience} then o.epoch else w.stop end
      from walk w join o on o.run = w.run and o.i = w.i + 1)
    select run, max(stop)::bigint as stop_epoch from walk group by run"""


def line(t: str) -> str:
    edge = rf"^[{SPACE}]+|[{SPACE}]+$"
    return swap(t, edge, "")


def error_samples(n: int) -> str:
    return f"""with {CORPUS}, {scored('corpus', 'doc_id, lang, label, text')}, {BUCKETED},
      r as (select *, row_number() over (partition by bucket order by doc_id) as rn from bucketed)
      select bucket, rn, doc_id, substring(text, 1, 200) as text, {NAME.format('label')} as true_label, {NAME.format('pred')} as predicted, {r6('confidence')} as confidence
      from r where rn <= {n}"""


LINEAR_SCORE = f"with {KNOWN.replace('SEED', '')} select doc_id, {r6('z')} as z, {r6('p')} as p, (z > 0)::int as pred from p"

ORACLES: dict[str, str] = {
    "q_read_split": f"with {SPLIT} select s.doc_id, s.lang, s.split, s.label, md5(d.text) as text_md5 from split s join documents d using (doc_id) where s.lang = 'en' and s.split = 'train'",
    "q_read_corpus": f"with {SPLIT} select s.doc_id, s.lang, s.split, s.label, md5(d.text) as text_md5 from split s join documents d using (doc_id)",
    "q_rewrite_language": f"""with {SPLIT} select s.doc_id, s.lang, s.split, case when s.lang = 'de' then 1 - s.label else s.label end as label, md5(d.text) as text_md5
      from split s join documents d using (doc_id) where s.lang in ('en', 'de')""",
    "q_encoded_files": f"""with {SPLIT}, docs as (select * from (select s.doc_id, s.lang, s.split, {clean('d.text')} as text from split s join documents d using (doc_id)) where text <> ''),
      ws as (select doc_id, lang, split, {words('text')} as w from docs), t as (select doc_id, unnest(w) as term from ws),
      top as (select term, count(*) as tf from t group by term order by tf desc, term limit 50000), vocab as (select term, row_number() over (order by term) - 1 as idx from top),
      p as (select doc_id, unnest(range(1, least(len(w), 128) + 1)) as pos, unnest(w[1:128]) as term from ws),
      e as (select p.doc_id, p.pos, v.idx is null as unknown, coalesce(v.idx + 2, 1) as id from p left join vocab v using (term))
      select ws.doc_id, ws.lang, ws.split, coalesce(count_if(e.unknown), 0)::bigint as n_unknown, count(e.id) as n_ids,
        md5(coalesce(string_agg(e.id::varchar, ',' order by e.pos), '')) as ids_md5 from ws left join e using (doc_id) group by ws.doc_id, ws.lang, ws.split""",
    "q_checked_csv": f"""with {RECORDS} select 'malformed' as kind, md5(record) as md5, null::int as label from records where doc_id % 10 < 3
      union all select 'good', md5(nullif(text, '')), label from records where doc_id % 10 >= 3""",
    "q_csv_run": f"""with {SPLIT}, r as (select s.doc_id, s.split, s.label, d.text from split s join documents d using (doc_id) where s.split in ('train', 'test')),
      good as (select split, label, {clean('text')} as text from r where doc_id % 10 >= 3), docs as (select row_number() over () as doc_id, 'x' as lang, text from good where split = 'train'),
      {TERMS}, terms as (select least(count(distinct term), 50000) as n from tc)
      select split as part, count_if(doc_id % 10 >= 3)::bigint as good, count_if(doc_id % 10 < 3)::bigint as malformed,
        case when split = 'train' then (select n from terms) else count_if(doc_id % 10 >= 3) end::bigint as used from r group by split""",
    "q_row_keys": """select lang, md5(case when doc_id % 2 = 0 then 'copy' else text end) as text_md5, count(*) as n, count(*) as n_keys from documents group by all""",
    "q_demo_corpus": f"""with {CORPUS}, keyed as (select doc_id, {clean('text')} as text, lower(trim({RAW_STRING})) as k from corpus),
      ready as (select * from (select doc_id, text, {STRING_LABEL} as label from keyed) where label is not null and text <> ''),
      {threeway('ready')} select split, label, count(*) as n from split group by all""",
    "q_holdout_source": f"""with {LABELLED}, base as (select doc_id, lang, label from labelled where lang <> 'de'), {holdout('base')}
      select doc_id, lang, label, split from split union all by name select doc_id, lang, label, 'test' as split from labelled where lang = 'de'""",
    "q_strip_html": f"select page_id, md5(t) as text_md5, length(t) as n_chars from (select page_id, {no_html('html')} as t from pages)",
    "q_clean_text": f"select page_id, md5(t) as text_md5, length(t) as n_chars from (select page_id, {clean('html')} as t from pages)",
    "q_strip_urls": "select page_id, " + no_urls("'see ' || url || ' now'") + " as text from pages",
    "q_strip_emails": f"select doc_id, md5({no_emails('text')}) as text_md5 from documents",
    "q_unwrap_tags": f"select doc_id, md5({no_marks('text')}) as text_md5 from documents",
    "q_norm_ws": f"select doc_id, md5({one_space('text')}) as text_md5 from documents",
    "q_lower": "select doc_id, md5(lower(text)) as text_md5 from documents",
    "q_clean_corpus": f"with {CLEAN_DOCS} select doc_id, md5(lower(text)) as text_md5 from docs",
    "q_changed_files_cache": f"with {CLEAN_DOCS} select doc_id, md5(lower(text)) as text_md5 from docs",
    "q_token_sketch": f"with {CLEAN_DOCS} select lang, mark::double as mark, count(*) as n, true as near from docs, (values (0.5), (0.95), (0.99)) m(mark) group by lang, mark",
    "q_cleaned_cache": f"with {CLEAN_DOCS} select doc_id, md5(lower(text)) as text_md5 from docs",
    "q_removed_observed": f"""select count(*) as before, count_if(t <> '')::bigint as after, count_if(t = '')::bigint as removed from (
      select {clean("text")} as t from documents)""",
    "q_removed_count": f"""select count(*) as before, count_if(t <> '')::bigint as after, count_if(t = '')::bigint as removed from (
      select {clean("text")} as t from documents)""",
    "q_tokens": f"with {CLEAN_DOCS} select doc_id, len(w)::bigint as n_tokens, len(list_distinct(w))::bigint as n_distinct from (select doc_id, {words('text')} as w from docs)",
    "q_ngrams": f"""with {CLEAN_CORPUS}, g as (select doc_id, {grams()} as g from (select doc_id, {words('text')} as w from docs))
      select doc_id, unnest(range(len(g)))::bigint as pos, unnest(g) as gram from g""",
    "q_ngrams_1_3": f"""with {CLEAN_DOCS}, g as (select doc_id, {grams(3)} as g from (select doc_id, {words('text')} as w from docs))
      select doc_id, len(g)::bigint as n_grams, md5(array_to_string(list_sort(g), '|')) as grams_md5 from g""",
    "q_explode_lines": f"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {line('x')}), lambda x: x <> '') as l from documents)
      select doc_id, unnest(range(len(l)))::bigint as line_no, md5(unnest(l)) as line_md5 from l""",
    "q_std_labels_int": """select * from (select doc_id, case when x = 2 then null when x = 1 or x > 2 then 1 else 0 end::bigint as label
      from (select doc_id, doc_id % 8 - 1 as x from documents)) where label is not null""",
    "q_std_labels_mixed": """with j as (select doc_id, doc_id % 14 as kind, (['1', '2.0', '"pos"', null, 'true', 'null', '2', '" Bad "', '0.5', '-3', '"7"', '[1]', 'false', '4'])[doc_id % 14 + 1]::json as j from documents),
      t as (select doc_id, kind, json_type(j) as type, lower(trim(j ->> '$')) as k from j)
      select * from (select doc_id, (case when kind = 3 then 0 when type = 'VARCHAR' then """ + STRING_LABEL + """
        when type = 'BOOLEAN' then (k = 'true')::int when type = 'DOUBLE' then (k::double > 0.5)::int
        when type in ('UBIGINT', 'BIGINT') then case when k::int = 2 then null when k::int = 1 or k::int > 2 then 1 else 0 end end)::bigint as label from t) where label is not null""",
    "q_std_labels_str": f"select * from (select doc_id, ({STRING_LABEL})::bigint as label from (select doc_id, lower(trim({RAW_STRING})) as k from documents)) where label is not null",
    "q_std_labels_float": """select event_id, case when isnan(x) then 0 when x > 0.5 then 1 else 0 end::bigint as label from (
      select event_id, case when event_id % 10 = 0 then 'nan'::double when event_id % 10 = 1 then null else value / 20.0::double end as x from events) where x is not null""",
    "q_label_map": "select doc_id, case doc_id % 3 when 1 then 1 else 0 end::bigint as label from documents where doc_id % 3 in (1, 2)",
    "q_label_map_toxic": "select doc_id, (1 - toxic)::bigint as label from labels where toxic in (0, 1)",
    "q_label_names": """select conv_id, turn, (role <> 'assistant')::int as label_id,
      case role when 'user' then 'positive' when 'assistant' then 'negative' else 'pos' end as label_name,
      case role when 'assistant' then 'negative' else 'positive' end as class_name from conversations""",
    "q_holdout_split": f"with {LABELLED}, {holdout('labelled')} select doc_id, split from split",
    "q_stratified_split": f"with {LABELLED}, {threeway('labelled')} select doc_id, split from split",
    "q_stratified_split_by_lang": f"with {SPLIT} select doc_id, lang, split from split",
    "q_split_balance": f"""with {SPLIT} select lang, split, count(*) as total, count_if(label = 1)::bigint as positive, count_if(label = 0)::bigint as negative,
      {r6('100.0 * (count_if(label = 1) / count(*))')} as pos_pct, {r6('100.0 * (count_if(label = 0) / count(*))')} as neg_pct from split group by all""",
    "q_combined": f"with {SPLIT} select doc_id, lang as language, label from split where split = 'train' and lang in ('en', 'de', 'fr', 'es')",
    "q_balanced_sample": f"""with {LABELLED}, n as (select min(c) as k from (select count(*) as c from labelled where lang in ('en', 'de', 'fr', 'es') group by lang)),
      r as (select *, row_number() over (partition by lang order by md5('42|' || doc_id), doc_id) as r from labelled where lang in ('en', 'de', 'fr', 'es'))
      select doc_id, lang as language from r, n where r <= k""",
    "q_capped_sample": f"with {CLEAN_DOCS} select doc_id from docs order by md5('42|' || doc_id), doc_id limit 100",
    "q_first_rows": f"with {LABELLED} select doc_id from labelled order by doc_id limit 100",
    "q_nested_subsets": f"with {nested('doc_id')} select seed, size, doc_id from subsets",
    "q_subset_balance": f"with {nested('doc_id, label')} select seed, size, count(*) as n, {r6('avg(label)')} as positive_share from subsets group by all",
    "q_mode_datasets": f"with {SPLIT} select mode, split as role, lang, count(*) as n from split, {MODES} where split = 'test' or list_contains(langs, lang) group by all",
    "q_corpus_stats": f"""with {CLEAN_CORPUS}, c as (select *, len(regexp_extract_all(text, '[^{SPACE}]+')) as words from docs)
      select lang, count(*) as total, count_if(label = 1)::bigint as positive, count_if(label = 0)::bigint as negative, {r6('count_if(label = 1) / count(*)')} as positive_ratio,
      {r6('avg(length(text))')} as avg_text_length, max(length(text)) as max_text_length, min(length(text)) as min_text_length,
      {r6('avg(words)')} as avg_word_count, max(words)::bigint as max_word_count from c group by lang""",
    "q_class_weights": f"""with {LABELLED}, c as (select lang, label, count(*) as n from labelled group by all)
      select lang, label, n, {r6('(sum(n) over (partition by lang)) / ((count(*) over (partition by lang)) * n)::double')} as weight from c""",
    "q_token_stats": f"""with {CLEAN_DOCS}, c as (select lang, len({words('text')})::bigint as n from docs)
      select lang, {r6('avg(n)')} as mean, {r6('stddev_pop(n)')} as std, min(n) as min, max(n) as max, {r6('quantile_cont(n, 0.5)')} as median,
      {r6('quantile_cont(n, 0.95)')} as p95, {r6('quantile_cont(n, 0.99)')} as p99 from c group by lang""",
    "q_confusion": f"with {SCORED}, {CELLS_LANG} select lang, tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, tp::bigint as tp from cells",
    "q_metrics": f"with {SCORED}, {CELLS_LANG}, {CLASSES} {SUMMARY}",
    "q_per_class": f"""with {SCORED}, {CELLS_LANG}, {CLASSES} select lang, cls as label, class, {r6('precision')} as precision, {r6('recall')} as recall, {r6('f1')} as f1, support::bigint as support from classes""",
    "q_class_report": f"""with {SCORED}, {CELLS_ALL}, {CLASSES}, a as (select any_value((tn + tp) / (tn + fp + fn + tp)) as acc, any_value(tn + fp + fn + tp)::bigint as n,
        avg(precision) filter (where present) as mp, avg(recall) filter (where present) as mr, avg(f1) filter (where present) as mf,
        sum(precision * support) / sum(support) as wp, sum(recall * support) / sum(support) as wr, sum(f1 * support) / sum(support) as wf from classes)
      select class as row, {r6('precision')} as precision, {r6('recall')} as recall, {r6('f1')} as f1, support::bigint as support from classes where present
      union all select 'accuracy', {r6('acc')}, {r6('acc')}, {r6('acc')}, n from a
      union all select 'macro avg', {r6('mp')}, {r6('mr')}, {r6('mf')}, n from a
      union all select 'weighted avg', {r6('wp')}, {r6('wr')}, {r6('wf')}, n from a""",
    "q_metrics_rollup": f"""with {SCORED}, {CELLS_LANG.replace('cells as', 'per as')},
      cells as (select * from per union all by name select 'ALL' as lang, sum(tn) as tn, sum(fp) as fp, sum(fn) as fn, sum(tp) as tp from per), {CLASSES} {SUMMARY}""",
    "q_error_counts": f"with {SCORED}, {BUCKETED} select bucket, count(*) as true_n, least(count(*), 50) as capped_n from bucketed group by bucket",
    "q_error_samples_5000": error_samples(5000),
    "q_error_samples": error_samples(5),
    "q_confidence_bands": f"with {scored('documents', 'doc_id')} select {phrase('score')} as band, {EMOJI} as emoji, count(*) as n from scored group by all",
    "q_batch_view": f"""with {scored('documents', 'doc_id, text')} select doc_id, case when length(text) > 50 then substring(text, 1, 50) || '...' else text end as text,
      {NAME.format('pred')} as sentiment, {tenth('100 * confidence')} as confidence, {phrase('confidence')} as band, {EMOJI} as emoji
      from scored where {line('text')} <> ''""",
    "q_batch_summary": f"with {scored('documents', 'doc_id, text')} select {NAME.format('pred')} as sentiment, count(*) as n from scored where {line('text')} <> '' group by all",
    "q_softmax": f"""with e as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding)))::int as place from embeddings),
      s as (select *, exp(x - max(x) over (partition by vec_id)) as y, first_value(place) over (partition by vec_id order by x desc, place) as pred from e)
      select vec_id, pred, place, {r6('y / sum(y) over (partition by vec_id)')} as p from s""",
    "q_term_counts": f"with {CLEAN_CORPUS}, {TERMS} select doc_id, term, c as n from tc",
    "q_term_df": f"with {CLEAN_DOCS}, {TERMS}, {STATS} select term, tf, df from st",
    "q_vocab_topk": f"with {VOCAB} select term, idx, tf, df from vocab",
    "q_vocab_pruned": f"with {VOCAB.replace('limit 50000', 'limit 5000')} select term, idx, tf, df, {r6('idf')} as idf from vocab",
    "q_idf": f"with {VOCAB} select term, {r6('idf')} as idf from vocab",
    "q_tfidf": TFIDF,
    "q_tfidf_bucketed": TFIDF,
    "q_sparse_rows": f"""with {VOCAB}, {WEIGHTS} select docs.doc_id, docs.lang, count(w.idx) as n_terms, md5(coalesce(string_agg(w.idx::varchar, ',' order by w.idx), '')) as indices_md5,
      md5(coalesce(string_agg(round(w / length * 100000)::bigint::varchar, ',' order by w.idx), '')) as values_md5
      from docs left join (select *, sqrt(sum(w * w) over (partition by doc_id)) as length from w) w using (doc_id) group by docs.doc_id, docs.lang""",
    "q_vocab_by_lang": f"""with {CLEAN_DOCS}, {TERMS}, mt as (select mode, lang, term, sum(c) as c from tc, {MODES} where list_contains(langs, lang) group by all),
      tot as (select mode, term, sum(c) as tf from mt group by all),
      top as (select *, row_number() over (partition by mode order by tf desc, term) as r from tot qualify r <= 50000),
      home as (select mode, term, lang as term_lang from mt semi join top using (mode, term) qualify row_number() over (partition by mode, term order by c desc, lang) = 1)
      select mode as train_set, term_lang, count(*) as n_terms from home group by all""",
    "q_encode": f"""with {CLEAN_DOCS}, ws as (select doc_id, {words('text')} as w from docs), t as (select doc_id, unnest(w) as term from ws),
      top as (select term, count(*) as tf from t group by term order by tf desc, term limit 50000), vocab as (select term, row_number() over (order by term) - 1 as idx from top),
      p as (select doc_id, unnest(range(1, least(len(w), 128) + 1)) as pos, unnest(w[1:128]) as term from ws),
      e as (select p.doc_id, p.pos, v.idx is null as unknown, coalesce(v.idx + 2, 1) as id from p left join vocab v using (term)),
      a as (select ws.doc_id, count(e.id) as n_ids, coalesce(count_if(e.unknown), 0)::bigint as n_unknown, coalesce(list(e.id order by e.pos) filter (where e.id is not null), []) as ids
            from ws left join e using (doc_id) group by ws.doc_id)
      select doc_id, n_ids, n_unknown, 128::bigint as n_padded, md5(array_to_string(list_concat(ids, list_transform(range(128 - n_ids), lambda i: 0)), ',')) as ids_md5 from a""",
    "q_linear_score": LINEAR_SCORE,
    "q_linear_score_bucketed": LINEAR_SCORE,
    "q_saved_model": LINEAR_SCORE,
    "q_stream_scores": LINEAR_SCORE,
    "q_model_metrics": known(f"""{CELLS_LANG.replace('cells as', 'per as')},
      cells as (select * from per union all by name select 'ALL' as lang, sum(tn) as tn, sum(fp) as fp, sum(fn) as fn, sum(tp) as tp from per), {CLASSES} {SUMMARY}"""),
    "q_model_per_class": known(f"""{CELLS_LANG}, {CLASSES} select lang, cls as label, class, {r6('precision')} as precision, {r6('recall')} as recall,
      {r6('f1')} as f1, support::bigint as support from classes"""),
    "q_model_error_counts": known(f"{BUCKETED} select bucket, count(*) as true_n, least(count(*), 50) as capped_n from bucketed group by bucket"),
    "q_model_error_samples": known(f"""{BUCKETED}, r as (select *, row_number() over (partition by bucket order by doc_id) as rn from bucketed)
      select bucket, rn, r.doc_id, substring(d.text, 1, 200) as text, {NAME.format('label')} as true_label, {NAME.format('pred')} as predicted, {r6('confidence')} as confidence
      from r join documents d on d.doc_id = r.doc_id where rn <= 50"""),
    "q_run_chain": f"""with a as ({known(f"{CELLS_LANG}, {CLASSES} select lang, 42 as seed, avg(f1) filter (where present) as f1 from classes group by lang", "42")}),
      b as ({known(f"{CELLS_LANG}, {CLASSES} select lang, 43 as seed, avg(f1) filter (where present) as f1 from classes group by lang", "43")}),
      s as (select lang, avg(f1) as mean, {STD.format('f1')} as std, count(*) as runs from (select * from a union all select * from b) group by lang)
      select 'known' as mode, {', '.join(f"max({cell('mean', 'std', 'runs')}) filter (lang = '{x}') as {x}" for x in ('en', 'de', 'fr', 'es'))} from s""",
    "q_lr_fit": f"""with {SPLIT}, docs as (select s.doc_id, s.lang, {clean('d.text')} as text from split s join documents d using (doc_id) where s.split = 'train'),
      {TERMS}, {STATS}, top as (select * from st order by tf desc, term limit 50000), nd as (select count(*) as n_docs from docs)
      select term, (row_number() over (order by term) - 1)::int as idx, df, {r6('ln((1 + n_docs) / (1 + df)::double) + 1')} as idf, true as settled from top, nd""",
    "q_grid_fit": f"""with {SPLIT}, docs as (select s.doc_id, s.lang, {clean('d.text')} as text from split s join documents d using (doc_id) where s.split = 'train'),
      {TERMS}, md as (select mode, doc_id from docs, {MODES} where list_contains(langs, lang)), nd as (select mode, count(*) as n_docs from md group by mode),
      st as (select mode, term, sum(c)::bigint as tf, count(*) as df from tc join md using (doc_id) group by all),
      top as (select * from st qualify row_number() over (partition by mode order by tf desc, term) <= 50000)
      select mode, term, df, {r6('ln((1 + n_docs) / (1 + df)::double) + 1')} as idf, true as settled from top join nd using (mode)""",
    "q_curve_fit": f"""with {SPLIT}, docs as (select s.doc_id, s.lang, {clean('d.text')} as text from split s join documents d using (doc_id) where s.split = 'train'),
      {TERMS}, av as (select count(*) as a from docs where lang = 'de'),
      grid as (select condition, size, seed from (select unnest(['target_only', 'source_first']) as condition), (select unnest([100, 250, 500, 1000, 2500, 9681]) as size), (select unnest([42, 43, 44]) as seed)),
      placed as (select doc_id, seed, row_number() over (partition by seed order by md5(seed || '|' || doc_id), doc_id) as place from docs, (select distinct seed from grid) where lang = 'de'),
      md as (select condition, size, seed, doc_id from grid join placed using (seed) where place <= size
             union all select condition, size, seed, doc_id from grid, docs where condition = 'source_first' and lang = 'en'),
      nd as (select condition, size, seed, count(*) as train_rows from md group by all),
      st as (select condition, size, seed, term, sum(c)::bigint as tf, count(*) as df from tc join md using (doc_id) group by all),
      top as (select * from st qualify row_number() over (partition by condition, size, seed order by tf desc, term) <= 50000)
      select condition, size, seed, least(size::bigint, any_value(a)) as examples, any_value(train_rows) as train_rows, count(*) as n_terms, sum(df)::bigint as sum_df, true as settled
      from top join nd using (condition, size, seed), av group by condition, size, seed""",
    "q_run_plan": f"with {PLAN} select condition, size, seed, examples, epochs, steps from full_plan",
    "q_pending_runs": f"""with {PLAN}, {RUNS}, done as (select case condition when 'click' then 'target_only' else 'source_first' end as condition, size, seed from runs
        where lang = 'en' and n % 2 = 1 and condition in ('click', 'view'))
      select condition, size, seed, examples, epochs, steps from full_plan anti join done using (condition, size, seed)""",
    "q_collect_runs": f"""with {MODE_RUNS}, r as (select * from runs union all by name select * exclude (seed), null as seed from runs where seed = 42)
      select mode, coalesce(seed, -1)::int as seed, lang, n, {r6('accuracy')} as accuracy, {r6('f1')} as f1 from r""",
    "q_collect_curve_runs": f"with {RUNS} select condition, size, seed::int as seed, lang, n, {r6('f1')} as f1 from runs",
    "q_seed_summary": f"""with {MODE_RUNS} select mode, lang, arg_min(n, seed) as n, arg_min(train_samples, seed) as train_samples, {r6('avg(accuracy)')} as accuracy_mean,
      {r6(STD.format('accuracy'))} as accuracy_std, {r6('avg(f1)')} as f1_mean, {r6(STD.format('f1'))} as f1_std, count(*) as runs,
      string_agg(seed::varchar, ',' order by seed) as seeds from runs group by mode, lang""",
    "q_curve_summary": f"""with {RUNS} select condition, size, lang, {r6('avg(f1)')} as mean, {r6(STD.format('f1'))} as std, count(*) as runs,
      string_agg(seed::varchar, ',' order by seed) as seeds, string_agg(floor(f1 * 1000)::bigint::varchar, ',' order by seed) as scores from runs group by condition, size, lang""",
    "q_curve_band": f"""with {BY_SIZE}, z as (select avg(f1) as zf from runs where lang = 'de' and condition = 'signup')
      select condition, size, {r6('100 * mean')} as mean, {r6('100 * mean - 100 * std')} as lo, {r6('100 * mean + 100 * std')} as hi, {r6('100 * zf')} as zero_shot from s, z""",
    "q_condition_diff": f"""with {BY_SIZE}, p as (select size, max(mean) filter (where condition = 'click') as a, max(mean) filter (where condition = 'view') as b
        from s where condition in ('click', 'view') group by size)
      select size, {tenth('100 * a')} as a_mean, {tenth('100 * b')} as b_mean, {tenth('100 * (b - a)')} + 0.0 as diff from p""",
    "q_curve_table": f"""with {RUNS}, s as (select condition, size, lang, avg(f1) as mean, {STD.format('f1')} as std, count(*) as runs from runs
        where not (condition = 'view' and size = 250) group by all)
      select z.size, {cell('a.mean', 'a.std', 'a.runs')} as click, {cell('b.mean', 'b.std', 'b.runs')} as view, coalesce(printf('%+.1f', 100 * (b.mean - a.mean)), '-') as difference,
        {cell('c.mean', 'c.std', 'c.runs')} as view_on_en
      from (select distinct size from s) z left join (select * from s where condition = 'click' and lang = 'de') a using (size)
      left join (select * from s where condition = 'view' and lang = 'de') b using (size) left join (select * from s where condition = 'view' and lang = 'en') c using (size)""",
    "q_results_table": f"""with runs as (select mode, model, seed, lang, {FIGURES} from (select event_type as mode, if(user_id % 2 = 0, 'linear', 'other') as model, {EVENT} from events) group by all),
      s as (select mode, model, lang, avg(f1) as mean, {STD.format('f1')} as std, count(*) as runs from runs where not (mode = 'error' and model = 'linear' and lang = 'de') group by all)
      select m.mode, m.model, {cell('e.mean', 'e.std', 'e.runs')} as en, {cell('d.mean', 'd.std', 'd.runs')} as de from (select distinct mode, model from s) m
      left join (select * from s where lang = 'en') e using (mode, model) left join (select * from s where lang = 'de') d using (mode, model)""",
    "q_accuracy_table": f"""with runs as (select mode, model, seed, lang, {FIGURES} from (select event_type as mode, if(user_id % 2 = 0, 'linear', 'other') as model, {EVENT} from events) group by all),
      s as (select mode, model, lang, avg(accuracy) as mean, {STD.format('accuracy')} as std, count(*) as runs from runs group by all)
      select m.mode, m.model, {cell('e.mean', 'e.std', 'e.runs')} as en, {cell('d.mean', 'd.std', 'd.runs')} as de from (select distinct mode, model from s) m
      left join (select * from s where lang = 'en') e using (mode, model) left join (select * from s where lang = 'de') d using (mode, model)""",
    "q_model_rows": f"with {MODE_RUNS} select mode, seed, lang, n, {tenth('100 * accuracy')} as accuracy_pct, {tenth('100 * f1')} as f1_pct from runs",
    "q_history": f"""with {LOG}, c as (select run, 2 * count(*) as n, count(score) as evaluations from log group by run),
      b as (select run, epoch as best_epoch, {r6('score')} as best_score from log qualify row_number() over (partition by run order by score desc, epoch) = 1)
      select run as mode, n, evaluations, best_epoch, best_score from c join b using (run)""",
    "q_best_epoch": f"""with {LOG} select run, epoch as best_epoch, {r6('score')} as best_score from log qualify row_number() over (partition by run order by score desc, epoch) = 1""",
    "q_early_stop": early("score", 2, 0.0),
    "q_early_stop_margin": early("-score", 3, 0.05),
}
