"""Thin queries over the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, exact_dedup, jaccard_join, language_id, licenses, line_dedup, mixing, packing, quality, secrets, spelling, suffix_dedup, token_files, tokens
from .common import documents, fresh_path

HELD_OUT = "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 3) = 1"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's locator is its file, known by the hash of its path, and its number there."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.xxhash64("_metadata.file_path").alias("file"), "_metadata.row_index")
    out = exact_dedup.exact_dedup(docs, locator=F.struct("file", "row_index"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").select("doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_docs(docs, quality.fit(docs, trusted(spark, sf_dir), rejected(spark, sf_dir)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    filters = language_id.fit(docs.where(f"not ({HELD_OUT})"))
    return language_id.predict(docs, filters).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


def domain() -> Column:
    """The tree's first level: a source's number modulo 4."""
    return F.concat(F.lit("d"), F.pmod(F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("long"), F.lit(0)), F.lit(4)))


DOMAIN_WEIGHTS = {"d0": 2.0, "d1": 1.0, "d2": 1.0, "d3": 1.0}
LANGUAGE_WEIGHTS = {"en": 6.0, "de": 2.0, "fr": 1.0, "es": 1.0}
BUDGET_SHARE = 0.8
EPOCHS = 2
SEED = 20240229


def levels() -> list[tuple[str, Column]]:
    return [("domain", domain()), ("language", F.col("lang")), ("origin", F.col("source"))]


def weights(path: tuple) -> float:
    """Siblings without a weight of their own count 1."""
    if len(path) == 1:
        return DOMAIN_WEIGHTS.get(path[0], 1.0)
    return LANGUAGE_WEIGHTS.get(path[1], 1.0) if len(path) == 2 else 1.0


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir), levels(), weights, BUDGET_SHARE, EPOCHS, SEED)
    return out.select(F.col("id").alias("doc_id"), "epoch", "domain", "language", "origin", "tokens", "leaf_budget", F.col("before").cast("long").alias("before"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_join(documents(spark, sf_dir), measure=jaccard_join.Measure(4, 85, 100))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    cuts = F.col("_mm_cuts")
    return out.select("doc_id", F.coalesce(F.size(cuts), F.lit(0)).cast("long").alias("n_passages"), line_dedup.cut_words(cuts).alias("n_removed_words"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(F.encode(secrets.as_text(F.col("base")), "UTF-8"), 256).alias("base_sha256")
    return out.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), base, secrets.as_text(F.sort_array(F.concat("base", "added"))).alias("spans"))


def encoder(name: str, piece, known: int | None = None):
    import public_tokenizers as public

    path = public.path(name)
    return lambda texts: [tokens.opened(path, piece, known).encode(t) for t in texts]


def byte_bpe(known: int | None = None):
    return encoder("byte_bpe_50k.json", tokens.byte_piece, known)


def word_bpe():
    return encoder("word_bpe_49k.json", tokens.word_piece)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), byte_bpe(), end_id=0, seed=SEED)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    token_files.write_ids(documents(spark, sf_dir), path, word_bpe(), end_id=1)
    return token_files.checked(spark, path)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans can end inside a character; the remaining text has U+FFFD for what is left of one."""
    out = suffix_dedup.suffix_dedup(documents(spark, sf_dir), with_text=True)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", F.expr("make_valid_utf8(cast(kept as string))").alias("text"))


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with faults: by the CRC of `conv_id:turn` a row is dropped, emptied, loses its sentence ends, is repeated or becomes the user's."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), (F.crc32(F.encode(F.concat_ws(":", named("conv_id"), named("turn")), "UTF-8")) % 20).alias("hurt"))
    text = F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hurt") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("hurt") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return t.where("hurt <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("nth")).drop("nth")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, turns = conversations.repair(damaged(spark, sf_dir))
    ids = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("conv")).distinct()
    out = conversations.joined([ids, plans, conversations.digests(turns)], "conv")
    number = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias("conv_id"), *number, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = (op1_exact_dedup, op2_jaccard_join, op3_line_dedup, op4_secret_scan, op5_packing, op6_language_id, op7_token_files, op8_suffix_dedup, op9_quality_rules, op10_mixing, op11_conversation_repair, op12_spelling_variants, op13_license_scan)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _secret_sql() -> str:
    """Positions follow from the pieces between matches, as neither engine reports them."""

    def scan(kind: str, pattern: str, group: int) -> str:
        p = pattern.replace("'", "''")
        return f"select doc_id, '{kind}' as kind, string_split_regex(t, '{p}') as pieces, regexp_extract_all(t, '{p}') as found, regexp_extract_all(t, '{p}', {group}) as vals from docs"

    scans = " union all ".join(scan(*x) for x in (*secrets.SCANS[:2], ("hex", secrets.HEX, 0), *secrets.SCANS[3:]))
    near = "exists (select 1 from {0} o where o.doc_id = p.doc_id and abs(o.s - p.s) <= 200)"
    return f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
scans as ({scans}),
cells as (select doc_id, kind, k, length(pieces[k]) as gap, length(found[k]) as n, length(vals[k]) as val from (select *, unnest(range(1, len(found) + 1)) as k from scans)),
parts as (select doc_id, kind, val, e - n as s, e from (select *, sum(gap + n) over (partition by doc_id, kind order by k) as e from cells)),
base as (select doc_id, kind, s, e from parts where kind = 'assign' and val >= 12 or kind = 'access' and val >= 18 or kind = 'hex' and val >= 16),
weak as (select doc_id, 'weak_secret' as kind, s, e from parts where kind = 'assign' and val between 6 and 11 or kind = 'bearer' and val >= 6),
ident as (select doc_id, 'identifier' as kind, s, e from parts where kind = 'identifier' and val >= 3 or kind = 'access' and val between 8 and 17),
keys as (select doc_id, s from weak union all select doc_id, s from base where kind = 'assign'),
names as (select doc_id, s from ident union all select doc_id, s from base where kind = 'access'),
spans as (
  select *, true as b from base
  union all select *, false from weak p where {near.format('names')}
  union all select *, false from ident p where {near.format('keys')}
  union all select doc_id, kind, s, e, false from parts p where kind = 'endpoint' and {near.format('names')} and {near.format('keys')}
),
texts as (select doc_id, b, kind, s, list_position(['assign', 'access', 'hex', 'identifier', 'weak_secret', 'endpoint'], kind) as o, kind || ':' || s::bigint || ':' || e::bigint as x from spans),
lists as (select doc_id, count(*) filter (b and kind = 'assign') as n_assign, count(*) filter (b and kind = 'access') as n_access, count(*) filter (b and kind = 'hex') as n_hex,
  string_agg(x, ',' order by s, o) filter (b) as base, string_agg(x, ',' order by s, o) as spans from texts group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join lists l on d.doc_id = l.doc_id
"""


#: CRC-32 by table: crc(x) of a string is an expression over its bytes; needs the table `crc_tab`.
CRC_TAB = "crc_tab as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab)"


def crc_sql(x: str) -> str:
    hex_digit = "instr('0123456789ABCDEF', substr(hx, {}, 1)) - 1"
    byte = f"({hex_digit.format('2 * k + 1')}) * 16 + {hex_digit.format('2 * k + 2')}"
    return f"(select xor(list_reduce([4294967295] || list_transform(range(length(hx) // 2), lambda k: ({byte})::bigint), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) from (select hex(encode({x})) as hx))"


def _repair_sql() -> str:
    """The fold is a recursion over positions with the four states as columns."""
    put = lambda p, step: f"{{'cost': {p}.cost + 2, 'audit': {p}.audit || 'I', 'path': {p}.path || '{step}'}}"
    edit = lambda p, cost, letter, step, when: f"case when {when} then {{'cost': {p}.cost + {cost}, 'audit': {p}.audit || '{letter}', 'path': {p}.path || '{step}'}} end"
    drop = lambda p: edit(p, 3, "D", "D", "true")
    keep = lambda p, i: edit(p, "more", "K", "K", f"stays and initial = '{i}'")
    give = lambda p, step: edit(p, "more + 2", "R", step, "stays")
    far = "{'cost': 1099511627776::bigint, 'audit': '', 'path': ''}"
    user = ", ".join([drop("c2"), *(keep(p, "u") for p in ("c0", "c1", "c3")), *(give(p, "U") for p in ("c0", "c1", "c3"))])
    inserted = lambda of: f"select *, s0 as c0, s1 as c1, least(s2, {put('s0', 'u')}, {put('s1', 'u')}, {put('s3', 'u')}) as c2, least(s3, {put('s2', 'a')}, {put('u0', 'a')}, {put('u1', 'a')}) as c3 from (select *, {put('s0', 'u')} as u0, {put('s1', 'u')} as u1 from {of})"
    return rf"""
with recursive {CRC_TAB},
hurt as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as h from conversations, crc_tab),
rows as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select * from hurt union all select * from hurt where h = 3) where h <> 0
),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from rows),
marked as (
  select *, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by pos) || left(role, 1) as pair, regexp_replace(text, '[ 	-
]+$', '') as body,
    row_number() over (partition by conv_id, role, text order by pos) > 1 as again from placed
),
turns as (select *, case when body = '' then 'blank' when again then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from marked),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n from turns group by conv_id
),
fold as (
  select conv_id, n, 0::bigint as pos, {{'cost': 0::bigint, 'audit': '', 'path': ''}} as s0, {far} as s1, {far} as s2, {far} as s3 from counts
  union all
  select conv_id, n, pos + 1, {drop("c0")}, least({drop("c1")}, {keep("c0", "s")}), least({user}), least({drop("c3")}, {keep("c2", "a")}, {give("c2", "A")})
  from (select f.*, t.initial, t.fault not in ('blank', 'duplicate') as stays, (t.fault = 'truncated')::bigint as more from ({inserted("fold")}) f join turns t on t.conv_id is not distinct from f.conv_id and t.pos = f.pos + 1)
),
best as (select conv_id, least(c0, c3) as p from ({inserted("(select * from fold where pos = n)")})),
steps as (select conv_id, unnest(regexp_extract_all(p.path, '[ua]*[UAKD]|[ua]+$')) as step, generate_subscripts(regexp_extract_all(p.path, '[ua]*[UAKD]|[ua]+$'), 1) as pos from best),
letters as (select conv_id, pos, unnest(string_split(step, '')) as c, generate_subscripts(string_split(step, ''), 1) as nth from steps),
lines as (
  select l.conv_id, l.pos, nth, case when c in ('u', 'U') then 'user' when c in ('a', 'A') then 'assistant' else t.role end || ':' || case when c in ('u', 'a') then '' else t.text end as line
  from letters l left join turns t on t.conv_id is not distinct from l.conv_id and t.pos = l.pos where c <> 'D'
),
bodies as (select conv_id, string_agg(line, chr(10) order by pos, nth) as body from lines group by conv_id)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(p.cost, 0)::bigint as cost, coalesce(p.audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join counts c on c.conv_id is not distinct from i.conv_id left join best b on b.conv_id is not distinct from i.conv_id left join bodies x on x.conv_id is not distinct from i.conv_id
"""


SPELLING_SQL = rf"""
with recursive {CRC_TAB},
runs as (
  select id, run, count(*) as n from (
    select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as run from documents
  ) where length(run) >= 6 group by all
),
hashed as (select run, n, {crc_sql("id || ':' || run")} as h from runs, crc_tab),
words as (
  select word, sum(n)::bigint as n from (select n, case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed)
  where length(word) >= 6 group by word having sum(n) >= 5
),
gaps as (select word, n, p, left(word, p - 1) || substr(word, p + 1) as rest from (select word, n, unnest(range(1, length(word) + 1))::int as p from words)),
near as (
  select a.word, b.word as other, b.n as other_n from gaps a join gaps b on a.p = b.p and a.rest = b.rest and a.word <> b.word
  union select g.word, w.word, w.n from gaps g join words w on w.word = g.rest
  union select w.word, g.word, g.n from gaps g join words w on w.word = g.rest
),
best as (select word, count(*) as n_near, min({{'o': -other_n, 'w': other}}) as b from near group by word),
known as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -b.o >= 5 * w.n then b.w end as form, case when -b.o >= 5 * w.n then -b.o end as form_n from words w left join best on best.word = w.word),
chain as (select word, word as top, 0 as k from known union all select c.word, f.form, k + 1 from chain c join known f on f.word = c.top where f.form is not null)
select k.word, form, c.root, n, n_near, form_n from known k join (select word, arg_max(top, k) as root from chain group by word) c on c.word = k.word
"""


def _license_sql() -> str:
    """Rules are rows; a text is split by each pattern whose anchor and keys it holds, and places are counted in blanks."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(r.label)}, {r.priority}, {r.confidence}::double, {quote(r.anchor)}, {quote(r.keys)}, {quote(licenses.spaced(r.pattern))})" for k, r in enumerate(licenses.rules()))
    blanks = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    return rf"""
with rules(rule, label, priority, confidence, anchor, keys, pattern) as (values {rows}),
docs as (select row_number() over () as uid, doc_id, list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: ' ' || w || ' ') as w from documents),
texts as (select uid, array_to_string(w, '') as t from docs),
tried as (select uid, rule, t, pattern, priority, confidence, label from texts, rules where contains(t, anchor) and len(list_filter(string_split(keys, '|'), lambda k: contains(t, k))) > 0),
found as (select *, string_split_regex(t, pattern) as pieces, regexp_extract_all(t, pattern) as matches from tried where regexp_matches(t, pattern)),
cells as (select uid, rule, priority, confidence, label, k, {blanks("pieces[k]")} as gap, {blanks("matches[k]")} as n from (select *, unnest(range(1, len(matches) + 1)) as k from found)),
hits as (select *, ((stop - n) / 2)::bigint as s, (stop / 2)::bigint as e from (select *, sum(gap + n) over (partition by uid, rule order by k) as stop from cells)),
outer_ones as (
  select * from hits h where priority >= 0 and not exists (select 1 from hits o where o.uid = h.uid and o.priority >= 0 and o.s <= h.s and o.e >= h.e and (o.s < h.s or o.e > h.e or (o.priority, o.rule) < (h.priority, h.rule)))
),
stay as (
  select uid, label, confidence, null as base from (
    select *, lag(e) over w > s and lag(priority) over w <= priority as lost_before, lead(s) over w < e and lead(priority) over w < priority as lost_after from outer_ones window w as (partition by uid order by s)
  ) where not coalesce(lost_before, false) and not coalesce(lost_after, false)
  union all select uid, label, confidence, s from hits where priority < 0
),
lists as (
  select uid, count(base) as n_base, min(base) as first_word, max(base) as last_word, string_agg(distinct label, ',' order by label) filter (base is not null) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(confidence) as score from stay group by uid
)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score from docs d left join lists l on l.uid = d.uid
"""


ORACLE_SQL = {
    "op13_license_scan": _license_sql(),
    "op11_conversation_repair": _repair_sql(),
    "op12_spelling_variants": SPELLING_SQL,
    "op4_secret_scan": _secret_sql(),
    "op2_jaccard_join": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
),
grams as (
  select distinct doc_id, array_to_string(w[k : k + 3], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as k from words where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n_both from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * n_both >= 85 * (x.n + y.n - n_both)),
ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from words union select r.a, w.b from reach r join ways w on r.b = w.a)
select w.doc_id, coalesce(n, 0) as n_shingles, (select min(b) from reach r where r.a = w.doc_id) as component_id from words w left join sizes s on s.doc_id = w.doc_id
""",
    "op1_exact_dedup": r"""
with d as (
  select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
)
select doc_id,
       first_value(doc_id) over (partition by norm order by chars desc, doc_id) as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over (partition by norm order by chars desc, doc_id) = 1 as kept,
       sha256(norm) as text_sha256
from d
""",
    "op3_line_dedup": r"""
with docs as (
  select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') as pieces from documents where text is not null
),
windows as (
  select doc_id, unnest(bodies) as body, generate_subscripts(bodies, 1) - 1 as wat
  from (select doc_id, list_transform(range(len(w) - 49), lambda i: md5(array_to_string(list_slice(w, i + 1, i + 50), ' '))) as bodies from docs where len(w) >= 50)
),
later as (
  select doc_id, wat, wat + 50 as stop from (select *, row_number() over (partition by body order by doc_id, wat) as nth from windows) where nth > 1
),
joined as (
  select doc_id, min(wat) as wat, max(stop) as stop from (
    select *, sum(opens) over (partition by doc_id order by wat) as passage from (
      select *, case when max(stop) over (partition by doc_id order by wat rows between unbounded preceding and 1 preceding) >= wat then 0 else 1 end as opens from later
    )
  ) group by doc_id, passage
),
passages as (
  select doc_id, count(*) as n, sum(stop - wat) as removed, min(wat) as head from joined group by doc_id
),
pieces as (
  select doc_id, unnest(pieces) as piece, generate_subscripts(pieces, 1) - 1 as k from docs where doc_id in (select doc_id from passages)
),
bodies as (
  select p.doc_id, string_agg(p.piece, '' order by p.k) as body from pieces p
  where not exists (select 1 from joined j where j.doc_id = p.doc_id and p.k >= j.wat and p.k < j.stop) group by p.doc_id
),
kept as (
  select d.doc_id, case when p.head = 0 then regexp_replace(x, '^\n', '') else x end as body
  from passages p join (
    select d.doc_id, coalesce(b.body, '') || substr(d.text, length(array_to_string(d.pieces, '')) + 1) as x from docs d left join bodies b on d.doc_id = b.doc_id
  ) d on d.doc_id = p.doc_id
)
select d.doc_id, coalesce(p.n, 0) as n_passages, coalesce(p.removed, 0)::bigint as n_removed_words, sha256(coalesce(k.body, d.text, '')) as kept_sha256
from documents d left join passages p on d.doc_id = p.doc_id left join kept k on d.doc_id = k.doc_id
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
