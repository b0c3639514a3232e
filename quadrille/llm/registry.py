"""The queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, licenses, packing, pii, quality, secrets, simhash, toxicity
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 as chosen and rejected; masks as start:end lists."""
    made = chat.preferences(chat.neighbours(table(spark, sf_dir, "conversations")))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return made.select("pair_id", "prompt_turns", "prompt", "chosen_completion", said("chosen_mask"), "rejected_completion", said("rejected_mask"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), packing.vocabulary_path())


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_preferences, op3_packing, op4_licenses, op5_toxicity, op6_simhash, op7_quality, op8_exact_dedup, op9_pii, op10_decontamination)}

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
_WORDS = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"

ORACLE_SQL = {
    "op2_preferences": """
with t as (select conv_id, conv_id // 2 as pair_id, conv_id % 2 as side, coalesce(role, '') as role, coalesce(text, '') as text,
                  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as k
           from conversations where conv_id is not null),
a as (select * from t where side = 0), b as (select * from t where side = 1),
p as (select coalesce(a.pair_id, b.pair_id) as pair_id,
             coalesce(min(case when a.k is null or b.k is null or a.role <> b.role or a.text <> b.text then coalesce(a.k, b.k) end), count(*)) as n
      from a full outer join b on a.pair_id = b.pair_id and a.k = b.k group by 1),
r as (select t.*, p.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as said, length(role) + 13 as head
      from t join p using (pair_id)),
c as (select *, sum(length(said)) over (partition by conv_id, k >= n order by k) as upto from r),
s as (select pair_id, side, any_value(n) as n, coalesce(string_agg(said, '' order by k) filter (where k < n), '') as prompt,
             coalesce(string_agg(said, '' order by k) filter (where k >= n), '') as completion,
             coalesce(string_agg(cast(cast(upto - length(said) + head as bigint) as varchar) || ':' || cast(cast(upto as bigint) as varchar), ',' order by k) filter (where k >= n and role = 'assistant'), '') as mask
      from c group by 1, 2)
select p.pair_id, cast(p.n as integer) as prompt_turns, coalesce(x.prompt, y.prompt) as prompt,
       coalesce(x.completion, '') as chosen_completion, coalesce(x.mask, '') as chosen_mask,
       coalesce(y.completion, '') as rejected_completion, coalesce(y.mask, '') as rejected_mask
from p left join s x on x.pair_id = p.pair_id and x.side = 0 left join s y on y.pair_id = p.pair_id and y.side = 1
""",
    "op4_licenses": f"""
with d as (select row_number() over () as r, doc_id, {_WORDS.format('text')} as w from documents where text is not null),
g as (select r, doc_id, len(w) - 1 as total, unnest(range(len(w) - 1)) as pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as gram from d where len(w) > 1),
tw as (select license, {_WORDS.format('notice')} as w from (values {_TEMPLATE_ROWS}) as x(license, notice)),
tg as (select license, len(w) as n_words, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as grams from tw),
h as (select g.*, t.license, t.n_words as width, len(t.grams) as n_pairs from g join (select *, unnest(grams) as gram from tg) t using (gram)),
s as (select a.r, a.doc_id, a.license, a.pos, least(any_value(a.width) - 1, any_value(a.total) - a.pos) as pairs, any_value(a.n_pairs) as n_pairs, count(*) as inside, count(distinct b.gram) as m
      from h a join h b on b.r = a.r and b.license = a.license and b.pos >= a.pos and b.pos < a.pos + a.width - 1 group by 1, 2, 3, 4),
x as (select *, round(2e0 * m / (n_pairs + pairs - inside + m), 6) as dice from s)
select doc_id, license, dice, cast(pos as integer) as start_word, cast(pairs + 1 as integer) as n_words
from (select *, row_number() over (partition by r, license order by dice desc, pos) as k from x where dice >= 0.8e0) where k = 1
""",
    "op8_exact_dedup": """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
""",
}
