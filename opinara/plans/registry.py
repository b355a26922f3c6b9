"""Registry of the review queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import lexicon as L
from opinara.functions import text as T
from opinara.operators import cleanse, contents, corpus, entities, evaluate, matching, naming, sampling, screening, spelling, summary, tagging, thai
from opinara.operators.matching import drop_inner_long, kept, token_hits
from opinara.sources import reviews as source

from . import analyze as plan
from . import incremental
from . import oracle as O
from .synthetic import DUMP_SQL, REVIEWS_SQL, dump, reviews

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cleaned(spark, sf_dir):
    return cleanse.clean(reviews(spark, sf_dir))


def tokenized(spark, sf_dir):
    return cleanse.tokenize(cleanse.normalize(cleaned(spark, sf_dir)))


def results(spark, sf_dir):
    # nothing is kept: a query computes the columns that it asks for
    return plan.analyze_batch(reviews(spark, sf_dir))


def pairs(column) -> F.Column:
    """A map as text, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- cleaning -------------------------------------------------------------------------------------------------------

@query(O.with_(O.R, O.R2) + f"select pos, {O.language('raw_text')} as lang from r2 union all select doc_id, {O.language('text')} from documents")
def lang_detect(spark, sf_dir):
    out = reviews(spark, sf_dir).select("pos", T.language(F.col("raw_text")).alias("lang"))
    return out.unionAll(docs(spark, sf_dir).select("doc_id", T.language(F.col("text")).alias("lang")))


@query(f"select page_id, regexp_matches(html, '{O.TAG}') or regexp_matches(html, '{O.ENTITY}') as had_html, {O.sub(O.sub('html', O.TAG), O.ENTITY)} as stripped from pages")
def html_strip(spark, sf_dir):
    html = F.col("html")
    return docs(spark, sf_dir, "pages").select("page_id", T.has_html(html).alias("had_html"), T.strip_html(html).alias("stripped"))


@query(O.with_(O.R) + f"select pos, (length(raw_text) - length({O.sub('raw_text', O.EMOJI, repr(''))}))::bigint as emoji_count, {O.sub('raw_text', O.EMOJI)} as stripped from r")
def emoji_strip(spark, sf_dir):
    raw = F.col("raw_text")
    return reviews(spark, sf_dir).select("pos", T.emoji_count(raw).cast("long").alias("emoji_count"), T.strip_emoji(raw).alias("stripped"))


_KINDS = ("url", "email", "line_id", "social", "phone")


@query(O.with_(*O.CLEAN) + " union all ".join(f"select pos, '{k}' as kind, unnest(f_{k}) as value from clean" for k in _KINDS))
def pii_extract(spark, sf_dir):
    return cleaned(spark, sf_dir).select("pos", F.explode("pii_removed").alias("kind", "values")).select("pos", "kind", F.explode("values").alias("value"))


@query(O.with_(*O.CLEAN) + "select pos, lang, had_html, emoji_count::bigint as emoji_count, clean_text from clean")
def clean_reviews(spark, sf_dir):
    return cleaned(spark, sf_dir).select("pos", "lang", "had_html", *long("emoji_count"), "clean_text")


@query(f"select doc_id, list_sort(list_distinct(regexp_extract_all(text, '{O.EMAIL}'))) as emails from documents where regexp_matches(text, '{O.EMAIL}')")
def document_emails(spark, sf_dir):
    found = F.array_sort(F.array_distinct(T.find_all(F.col("text"), T.EMAIL)))
    return docs(spark, sf_dir).where(F.col("text").rlike(T.EMAIL)).select("doc_id", found.alias("emails"))


@query(f"select doc_id, {O.strip(O.sub('text', chr(92) + 's{2,}'))} as squeezed from documents")
def whitespace_squeeze(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.squeeze(F.col("text")).alias("squeezed"))


@query(f"select doc_id, translate(text, '{O.UPPER}', '{O.UPPER.lower()}') as lowered from documents")
def lower_latin(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.lower_latin(F.col("text")).alias("lowered"))


_VOCAB = "v as (select word, row_number() over (order by n desc, word) - 1 as rank from (select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) group by word) where n >= 50 and length(word) >= 2)"


@query("with " + _VOCAB + " select word, rank from v")
def vocab_build(spark, sf_dir):
    vocab = cleanse.vocabulary(docs(spark, sf_dir), "text")
    return sampling.numbered(vocab, "n", "rank", ("word",), descending=True).select("word", *long("rank"))


def _vocab(spark, sf_dir):
    return cleanse.ranks(cleanse.vocabulary(docs(spark, sf_dir), "text"))


@query(O.with_(O.R, _VOCAB) + """, part as (select pos, g[k + 1] as gap, m[k + 1] as w, k from (select pos, regexp_split_to_array(raw_text, '[a-zA-Z]+') as g, regexp_extract_all(raw_text, '[a-zA-Z]+') as m, unnest(range(len(regexp_split_to_array(raw_text, '[a-zA-Z]+')))) as k from r)),
one as (select distinct lower(w) as low from part where length(w) >= 5 and lower(w) not in (select word from v)),
cut as (select low, unnest(range(2, length(low) - 1)) as i from one),
best as (select low, arg_min(substr(low, 1, i) || ' ' || substr(low, i + 1), (a.rank + b.rank) * 100 + i) as mended from cut join v a on a.word = substr(low, 1, i) join v b on b.word = substr(low, i + 1) group by low)
select pos, string_agg(gap || coalesce(mended, w, ''), '' order by k) as mended from part left join best on best.low = lower(part.w) and length(part.w) >= 5 group by pos""")
def glued_split(spark, sf_dir):
    fix = cleanse.word_fixer(spark, _vocab(spark, sf_dir), "split")
    return reviews(spark, sf_dir).select("pos", fix("raw_text").alias("mended"))


@query(O.with_(O.R, _VOCAB) + """, part as (select pos, g[k + 1] as gap, m[k + 1] as w, k from (select pos, regexp_split_to_array(raw_text, '[a-zA-Z]+') as g, regexp_extract_all(raw_text, '[a-zA-Z]+') as m, unnest(range(len(regexp_split_to_array(raw_text, '[a-zA-Z]+')))) as k from r)),
single as (select *, """ + "".join("regexp_replace(" for _ in "abcdefghijklmnopqrstuvwxyz") + "lower(w)" + "".join(f", '{c}{c}', '{c}', 'g')" for c in "abcdefghijklmnopqrstuvwxyz") + """ as s from part)
select pos, string_agg(gap || case when w is null then '' when lower(w) in (select word from v) then w when s in (select word from v) then s else w end, '' order by k) as mended from single group by pos""")
def double_fix(spark, sf_dir):
    fix = cleanse.word_fixer(spark, _vocab(spark, sf_dir), "double")
    return reviews(spark, sf_dir).select("pos", fix("raw_text").alias("mended"))


@query(O.with_(O.R) + f"select pos, {O.collapse('raw_text')} as collapsed from r union all select doc_id, {O.collapse('text')} from documents")
def elongation(spark, sf_dir):
    out = reviews(spark, sf_dir).select("pos", T.collapse(F.col("raw_text")).alias("collapsed"))
    return out.unionAll(docs(spark, sf_dir).select("doc_id", T.collapse(F.col("text")).alias("collapsed")))


# --- words ----------------------------------------------------------------------------------------------------------

@query(O.with_(*O.TOKENS) + "select pos, normalized_text, tokens, tokens_clean from tok")
def tokenize_reviews(spark, sf_dir):
    return tokenized(spark, sf_dir).select("pos", "normalized_text", "tokens", "tokens_clean")


@query(f"select doc_id, regexp_extract_all(text, '{O._PLAIN}') as tokens from documents")
def tokenize_fallback(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.plain_tokens(F.col("text")).alias("tokens"))


@query()
def thai_tokenize(spark, sf_dir):
    rows = reviews(spark, sf_dir).where(F.col("raw_text").rlike(f"[{T.THAI}]"))
    return rows.select("pos", cleanse.thai_tokenizer()(F.col("raw_text")).alias("tokens"))


_MINED = """c as (select regexp_extract_all(run, '{0}') as c, count(*) as m from (select unnest(regexp_extract_all(raw_text, '[ก-๙]+')) as run from r) group by run),
g as (select c, m, i, unnest(range(1, least(6, len(c) - i + 1) + 1)) as k from (select c, m, unnest(range(1, len(c) + 1)) as i from c)),
gram as (select array_to_string(c[i:i + k - 1], '') as gram, k, m, case when i > 1 then c[i - 1] end as near_l, c[i + k] as near_r from g),
nl as (select gram, near_l as near, sum(m) as m from gram group by 1, 2), nr as (select gram, near_r as near, sum(m) as m from gram group by 1, 2),
el as (select gram, sum(case when near is not null then m * log2(m) else 0 end) as l from nl group by 1), er as (select gram, sum(case when near is not null then m * log2(m) else 0 end) as r from nr group by 1),
n as (select gram, k, sum(m) as n from gram group by 1, 2), f as (select gram, k, n, log2(n) - greatest(l, r) / n as freedom from n join el using (gram) join er using (gram)),
cut as (select gram, n, freedom, array_to_string(c[1:i], '') as a, array_to_string(c[i + 1:], '') as b from (select gram, n, freedom, c, unnest(range(1, k)) as i from (select *, regexp_extract_all(gram, '{0}') as c from f where n >= 20 and k >= 2 and freedom >= 1.5))),
tie as (select cut.gram, cut.n, cut.freedom, min(log2(cut.n * (select sum(n) from f where k = 1) / (x.n::double * y.n))) as cohesion from cut join f x on x.gram = a join f y on y.gram = b group by 1, 2, 3)
""".format(thai.CLUSTER)


@query(O.with_(O.R, _MINED) + "select gram as word, n::bigint as n, round(freedom, 6) as freedom, round(cohesion, 6) as cohesion from tie where cohesion >= 3.0")
def thai_words(spark, sf_dir):
    found = thai.mine_words(reviews(spark, sf_dir), "raw_text")
    return found.select("word", "n", F.round("freedom", 6).alias("freedom"), F.round("cohesion", 6).alias("cohesion"))


@query()
def thai_tokenize_mined(spark, sf_dir):
    # a vocabulary of checked size, mined from the texts themselves, beside the lexicons
    rows = reviews(spark, sf_dir).where(F.col("raw_text").rlike(f"[{T.THAI}]"))
    words = cleanse.dictionary() | set(cleanse.ranks(thai.mine_words(rows, "raw_text")))
    return rows.select("pos", cleanse.thai_tokenizer(words)("raw_text").alias("tokens"))


@query(O.with_(O.R) + r"""select pos, list_transform(regexp_extract_all(raw_text, '[a-zA-Zก-๙]+|\p{Nd}+'), lambda t: t || '/X') as tags from r""")
def pos_tags(spark, sf_dir):
    out = cleanse.tag_words(reviews(spark, sf_dir).withColumn("tokens", T.plain_tokens(F.col("raw_text"))))
    return out.select("pos", F.transform("pos_tags", lambda p: F.concat(p["word"], F.lit("/"), p["tag"])).alias("tags"))


@query()
def pos_tags_learned(spark, sf_dir):
    # learned from the words of the small table below in their sentences; all words of the reviews are tagged, equal texts once
    rows, path = reviews(spark, sf_dir).select("pos", "raw_text"), source.scratch(spark, "tagged")
    rows.groupBy("raw_text").agg(F.count("*").alias("n")).write.parquet(path)
    model = tagging.fit(spark.read.parquet(path).select(_tagger(T.plain_tokens(F.col("raw_text"))).alias("pos_tags"), "n"), times="n")
    source.discard(spark, path)

    def step(found: DataFrame) -> DataFrame:
        out = cleanse.tag_words(found.withColumn("tokens", T.once(T.plain_tokens(F.col("raw_text")))), tagging.tagger(spark, model))
        return out.withColumn("tags", F.transform("pos_tags", lambda p: F.concat(p["word"], F.lit("/"), p["tag"])))

    return contents.on_distinct(rows, {"raw_text": F.col("raw_text")}, step).select("pos", "tags", "keywords")


#: A small table of word classes, a small vocabulary and patterns of names, in place of models: they drive all that rests on models.
_CLASSES = {"good": "ADJ", "nice": "ADJ", "bad": "ADJ", "great": "ADJ", "excellent": "ADJ", "ดี": "ADJ", "product": "NOUN", "delivery": "NOUN", "seller": "NOUN", "phone": "NOUN", "like": "VERB", "works": "VERB", "buy": "VERB", "speaker": "PROPN", "kettle": "PROPN", "box": "PROPN", "issue": "PROPN", "ok": "PROPN"}
_KNOWN = ["the", "of", "this", "that", "was", "and", "good", "so", "product", "excellent", "never", "delivery", "very", "not"]
_NAMES = {"org": "Kerry Express|support|speaker|Samsung", "place": "delivery|kettle", "date": "[0-9]+ days"}


def _tagger(tokens: F.Column) -> F.Column:
    classes = F.create_map(*(F.lit(x) for pair in _CLASSES.items() for x in pair))
    return F.transform(tokens, lambda t: F.struct(t.alias("word"), F.coalesce(F.try_element_at(classes, F.lower(t)), F.lit("X")).alias("tag")))


def _names(text: F.Column) -> F.Column:
    return F.struct(*(T.find_all(text, p).alias(kind) for kind, p in _NAMES.items()))


@query()
def names_learned(spark, sf_dir):
    # learned from all texts, in which the patterns above mark names; names are looked for in all texts, both times in equal ones once
    rows = reviews(spark, sf_dir).select("pos", F.col("raw_text").alias("text"))
    known = rows.select("text").distinct().select("text", T.once(_names(F.col("text"))).alias("known"))
    find = naming.finder(spark, naming.fit(known.select("text", "known.org", "known.place")))
    out = contents.on_distinct(rows, {"text": F.col("text")}, lambda found: found.withColumn("found", find("text")))
    return out.select("pos", "found.org", "found.place")


_TAG = "coalesce(map(" + O.strings(_CLASSES) + ", " + O.strings(_CLASSES.values()) + ")[lower(t)], 'X')"
_NONE = "cast([] as varchar[])"
_FOUND = {kind: f"case when lang = 'en' then regexp_extract_all(clean_text, '{p}') else {_NONE} end" for kind, p in _NAMES.items()}
_MODELS_SQL = O.with_(*O.mended(_KNOWN), *O.ASPECTS[len(O.NORMAL):], O.kept("kl", O.strings(L.PROVINCES)),
    "places as (select pos, list(distinct term) as location from kl join tok using (pos) where lang = 'th' and (not list_contains(" + O.strings(L.AMBIGUOUS_PROVINCES) + f", term) or regexp_matches(substr(array_to_string(low, ' '), 1, s), '{L.PROVINCE_MARKER}')) group by pos)",
    f"tagged as (select *, list_filter(tokens, lambda t: {_TAG} in ('NOUN', 'PROPN', 'ADJ', 'VERB')) as content, list_filter(tokens, lambda t: {_TAG} = 'PROPN' and length(t) > 2)[1:3] as proper, {O.gazetteer('clean_text', L.BRANDS)} as brand, "
    f"list_transform(list_concat(list_concat({O.gazetteer('clean_text', L.BRANDS)}, {O.gazetteer('clean_text', L.COURIERS)}), {O.gazetteer('clean_text', L.PLATFORMS)}), lambda x: lower(x)) as known, "
    f"{_FOUND['org']} as org, {_FOUND['place']} as spot, {_FOUND['date']} as said, list_distinct(regexp_extract_all(clean_text, '[0-9]{{1,2}}\\s*(?:{L.THAI_MONTHS})\\s*[0-9]{{2,4}}|(?:{L.THAI_MONTHS})\\s*[0-9]{{2,4}}')) as dates from tok)",
    "shops as (select *, list_filter(org, lambda x: not list_contains(known, lower(x))) as shop from tagged)",
    f"adj as (select pos, t, i from (select pos, unnest(tokens) as t, unnest(range(len(tokens))) as i from tok) where {_TAG} = 'ADJ')",
    "sides as (select pos, term, good, o from side union all select adj.pos, t, good, 1000000000 + i from adj join (select unnest(" + O.strings(L.GENERAL_POSITIVE) + ") as w, true as good union all select unnest(" + O.strings([w for w in L.GENERAL_NEGATIVE if w not in L.GENERAL_POSITIVE]) + "), false) on w = lower(t) where not exists (select 1 from side where side.pos = adj.pos and side.term = lower(t)))",
    "sides2 as (select pos, term, good, min(o) as o from sides group by pos, term, good)",
    "pick2 as (select pos, term, good, row_number() over (partition by pos, good order by o) as j from sides2 a where not exists (select 1 from sides2 b where b.pos = a.pos and b.good = a.good and b.term <> a.term and contains(b.term, a.term)))",
    "praise as (select pos, list(term order by j) filter (where good and j <= 8) as pros, list(term order by j) filter (where not good and j <= 8) as cons from pick2 group by pos)",
)


def _ordered(x: str) -> str:
    """The first of equal words kept, in order."""
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


@query(_MODELS_SQL + f"select pos, clean_text, normalized_text, {_ordered('content')}[1:10] as keywords, list_sort(list_distinct(case when len(brand) = 0 and len(shop) = 0 then proper else shop end)) as seller_shop, "
    f"list_sort(list_distinct(case when lang = 'th' then coalesce(location, {_NONE}) else spot end)) as location, list_sort(list_distinct(list_concat(dates, said))) as date_mentioned, coalesce(pros, {_NONE}) as pros, coalesce(cons, {_NONE}) as cons from shops left join places using (pos) left join praise using (pos)")
def analysis_with_models(spark, sf_dir):
    vocab = spark.createDataFrame([(w,) for w in _KNOWN], "word string")
    out = plan.analyze_batch(reviews(spark, sf_dir), vocab=vocab, tagger=_tagger, ner=_names)
    return out.select("pos", "clean_text", "normalized_text", "keywords", "seller_shop", "location", "date_mentioned", "pros", "cons")


# --- matching -------------------------------------------------------------------------------------------------------

@query(O.with_(*O.HITS) + "select pos, term, s::bigint as start, e::bigint as finish from hit")
def lexicon_hits(spark, sf_dir):
    out = tokenized(spark, sf_dir).select("pos", F.explode(token_hits(F.col("tokens"), plan.TERMS)).alias("h"))
    return out.select("pos", "h.term", F.col("h.start").cast("long").alias("start"), (-F.col("h.neg")).cast("long").alias("finish"))


@query(O.with_(*O.HITS, O.kept("k", O.strings(t for t, _ in L.general_terms()))) + "select pos, list(term order by s, e desc, ord) as terms from k group by pos")
def matched_terms(spark, sf_dir):
    words = [t for t, _ in L.general_terms()]
    found = tokenized(spark, sf_dir).withColumn("hits", token_hits(F.col("tokens"), words))
    out = found.select("pos", F.transform(kept(F.col("hits")), lambda h: h["term"]).alias("terms"))
    return out.where(F.size("terms") > 0)


@query("select doc_id, list_filter(w, lambda t: len(list_filter(w, lambda u: u <> t and contains(u, t))) = 0) as outer_words from (select doc_id, list(t order by i) as w from (select doc_id, t, min(i) as i from (select doc_id, unnest(string_split(text, ' ')) as t, unnest(range(len(string_split(text, ' ')))) as i from documents) group by doc_id, t) group by doc_id)")
def drop_substrings(spark, sf_dir):
    words = F.split("text", " ")
    return docs(spark, sf_dir).select("doc_id", drop_inner_long(words).alias("outer_words"))


_SPELL = _VOCAB + ", u as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents), w as (select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) where word in (select word from v) group by word)"


def _near(sql: str) -> str:
    return f"""with {_SPELL}, p as (select token, word, n, levenshtein(token, word) as distance from u, w where length(token) >= 3 and token not in (select word from v) and abs(length(token) - length(word)) <= 2),
f as (select token, arg_min((word, distance, n), (distance, -n, word)) as b from p where distance <= case when length(token) < 5 then 1 else 2 end group by token) {sql}"""


def _spelling(spark, sf_dir):
    """(known words, corrections) of the documents, each a table: words are counted once."""
    path = source.scratch(spark, "spelling")
    words = docs(spark, sf_dir).select(F.explode(T.find_all(F.lower("text"), "[a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words.write.parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    words.where("n >= 50 and length(word) >= 2").write.parquet(f"{path}/known")
    known = spark.read.parquet(f"{path}/known")
    spelling.corrections(words.select(F.col("word").alias("token")), known).write.parquet(f"{path}/found")
    return known, spark.read.parquet(f"{path}/found")


@query(_near("select token, b[1] as word, b[2]::bigint as distance, b[3] as n from f"))
def spell_corrections(spark, sf_dir):
    return _spelling(spark, sf_dir)[1].select("token", "word", *long("distance"), "n")


@query(_near(", t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token, unnest(range(len(regexp_extract_all(lower(text), '[a-z]+')))) as i from documents) select doc_id, string_agg(coalesce(b[1], token), ' ' order by i) as corrected from t left join f using (token) group by doc_id"))
def spell_correct(spark, sf_dir):
    known, corrections = _spelling(spark, sf_dir)
    found = spelling.correct(docs(spark, sf_dir).select("doc_id", T.find_all(F.lower("text"), "[a-z]+").alias("words")), "doc_id", "words", corrections, known)
    return found.where(F.size("words") > 0).select("doc_id", F.array_join("words", " ").alias("corrected"))


# --- entities -------------------------------------------------------------------------------------------------------

@query(O.with_(*O.NORMAL) + f"select pos, {O.PRICE} as price, ({O.DAYS})::bigint as delivery_days, {O.STARS} as star_rating from normal")
def price_days_stars(spark, sf_dir):
    return results(spark, sf_dir).select("pos", "price", *long("delivery_days"), "star_rating")


@query(O.with_(*O.CLEAN) + f""", m as (select pos, unnest(regexp_extract_all(clean_text, '{O._VAR}')) as w, unnest(regexp_extract_all(clean_text, '{O._VAR}', 1)) as v, unnest(range(len(regexp_extract_all(clean_text, '{O._VAR}')))) as i from clean),
k as (select pos, lower(regexp_replace(regexp_extract(w, '^\\s*(\\S+)', 1), '[:：]+$', '')) as k, v, i from m where lower(v) not in ('ที่', 'และ', 'the', 'of'))
select pos, k as kind, arg_min(v, i) as value from k group by pos, k""")
def variant_pairs(spark, sf_dir):
    return results(spark, sf_dir).select("pos", F.explode("variant").alias("kind", "value"))


@query(O.with_(*O.CLEAN) + f"select pos, list_sort(list_distinct(regexp_extract_all(clean_text, '[0-9]{{1,2}}\\s*(?:{L.THAI_MONTHS})\\s*[0-9]{{2,4}}|(?:{L.THAI_MONTHS})\\s*[0-9]{{2,4}}'))) as dates from clean")
def thai_dates(spark, sf_dir):
    return results(spark, sf_dir).select("pos", F.col("date_mentioned").alias("dates"))


#: Phrases with the date of an order, written in Spark's and in DuckDB's formats.
_SAID = [("concat('arrived on ', {0}, ' after 3 days')", "MMMM d, yyyy", "%B %-d, %Y"), ("concat('bought ', {0}, ', broken two weeks ago')", "d MMM", "%-d %b"), ("concat({0}, ' was a Monday')", "yyyy-MM-dd", "%Y-%m-%d"),
    ("concat('since ', {0}, ' or last week; lasted 2 months')", "MMM yyyy", "%b %Y"), ("concat('on ', {0}, '/1999x and 05/02/2001')", "d/M", "%-d/%-m"), ("concat('may be ', {0}, ' or mayday 2000')", "EEEE", "%A")]
_DATED = "(case {pick} " + " ".join(f"when {k} then {t}" for k, (t, _, _) in enumerate(_SAID)) + " end)"


@query("with s as (select o_orderkey as pos, " + _DATED.format(*["?"], pick="o_orderkey % 6").replace("?", "d") + f" as said from (select *, case o_orderkey % 6 " + " ".join(f"when {k} then strftime(o_orderdate, '{f}')" for k, (_, _, f) in enumerate(_SAID)) + " end as d from orders) union all select doc_id, text from documents)"
    + r" select pos, list_sort(list_distinct(regexp_extract_all(said, '(?i)\b(?:" + entities.ENGLISH_DATE + r")\b'))) as dates from s")
def english_dates(spark, sf_dir):
    forms = F.coalesce(*(F.when(F.col("o_orderkey") % 6 == k, F.date_format("o_orderdate", f)) for k, (_, f, _) in enumerate(_SAID)))
    said = docs(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderkey", forms.alias("d")).select("pos", F.expr(_DATED.format("d", pick="cast(o_orderkey % 6 as int)")).alias("said"))
    return said.unionAll(docs(spark, sf_dir).select("doc_id", "text")).select("pos", entities.english_dates(F.col("said")).alias("dates"))


@query(O.with_(*O.CLEAN) + f"select pos, {O.gazetteer('clean_text', L.BRANDS)} as brand, {O.gazetteer('clean_text', L.COURIERS)} as courier, {O.gazetteer('clean_text', L.PLATFORMS)} as platform from clean")
def gazetteers(spark, sf_dir):
    found = matching.gazetteers(F.col("clean_text"), {"brand": L.BRANDS, "courier": L.COURIERS, "platform": L.PLATFORMS})
    return cleaned(spark, sf_dir).select("pos", found.alias("f")).select("pos", "f.*")


_AMBIGUOUS = O.strings(L.AMBIGUOUS_PROVINCES)


@query(O.with_(*O.HITS, O.kept("kl", O.strings(L.PROVINCES))) + f"select pos, list_sort(list(distinct term)) as location from kl join tok using (pos) where lang = 'th' and (not list_contains({_AMBIGUOUS}, term) or regexp_matches(substr(array_to_string(low, ' '), 1, s), '{L.PROVINCE_MARKER}')) group by pos")
def locations(spark, sf_dir):
    return results(spark, sf_dir).where(F.size("location") > 0).select("pos", "location")


_TYPES = [(w, k, c) for k, (c, ws) in enumerate(L.PRODUCT_TYPES.items()) for w in ws]
_TYPE_ROWS = ", ".join(f"({O.quote(w)}, {k}, {O.quote(c)})" for w, k, c in _TYPES)


@query(O.with_(*O.HITS, "types(term, k, c) as (values " + _TYPE_ROWS + ")",
    "byname as (select pos, arg_min(c, p * 100 + k) as c from (select pos, c, k, instr(' ' || lower(product_name) || ' ', ' ' || term || ' ') as p from r, types) where p > 0 group by pos)",
    "bytext as (select pos, arg_min(c, s * 100 + k) as c from hit join types using (term) group by pos)")
    + "select pos, coalesce(byname.c, bytext.c, '') as product_type from r left join byname using (pos) left join bytext using (pos)")
def product_types(spark, sf_dir):
    return results(spark, sf_dir).select("pos", "product_type")


# --- aspects --------------------------------------------------------------------------------------------------------

@query(O.with_(*O.ASPECTS) + "select pos, sentiment, aspects, overall_sentiment, total::bigint as score_total, size::bigint as score_size, " + O.SCORE + " as sentiment_score from mood")
def aspect_sentiment(spark, sf_dir):
    return results(spark, sf_dir).select("pos", pairs("aspect_sentiment").alias("sentiment"), "aspects", "overall_sentiment", *long("score_total", "score_size"), "sentiment_score")


@query(O.with_(*O.ASPECTS) + "select pos, coalesce(pros, []) as pros, coalesce(cons, []) as cons from tok left join proscons using (pos)")
def pros_cons(spark, sf_dir):
    return results(spark, sf_dir).select("pos", "pros", "cons")


@query(O.with_(*O.ASPECTS) + "select pos, aspect, list(term order by length(term) desc, term)[1:6] as evidence from (select distinct pos, aspect, term from pair) group by pos, aspect")
def aspect_evidence(spark, sf_dir):
    return results(spark, sf_dir).select("pos", F.explode("aspect_evidence").alias("aspect", "evidence"))


@query(O.with_(*O.ASPECTS) + "select pos, term, s::bigint as start, p::bigint as polarity from gen")
def general_hits(spark, sf_dir):
    return results(spark, sf_dir).select("pos", F.explode("general_hits").alias("g")).select("pos", "g.term", F.col("g.start").cast("long").alias("start"), F.col("g.polarity").cast("long").alias("polarity"))


# --- screening ------------------------------------------------------------------------------------------------------

_FIRST = "select doc_id, {fp} as fingerprint, coalesce(case when first_value(doc_id) over w < doc_id then first_value(doc_id) over w end, -1)::bigint as duplicate_of from documents window w as (partition by {fp} order by doc_id)"


@query(_FIRST.format(fp=O.fingerprint(O.strip("text"))))
def duplicates(spark, sf_dir):
    out = screening.mark_duplicates(docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id", "doc_id")
    return out.select("doc_id", "fingerprint", F.coalesce("duplicate_of", F.lit(-1)).cast("long").alias("duplicate_of"))


_SCREEN_SQL = O.with_(*O.SCREEN) + "select pos, review_status, credibility_score::bigint as credibility_score, spam_signals, contact and promo as is_ad_spam, short or generic as is_low_quality, dup_of is not null as is_duplicate, coalesce(dup_of, '') as duplicate_of, " + O.REASONS + " as reasons from screen"


def _screened(out: DataFrame) -> DataFrame:
    reasons = F.transform("screening_reasons", lambda r: F.concat_ws("/", r["reason"], r["penalty"])).alias("reasons")
    return out.select("pos", "review_status", *long("credibility_score"), "spam_signals", "is_ad_spam", "is_low_quality", "is_duplicate", "duplicate_of", reasons)


@query(_SCREEN_SQL)
def screening_results(spark, sf_dir):
    return _screened(results(spark, sf_dir))


@query(_SCREEN_SQL)
def incremental_analysis(spark, sf_dir):
    # the second run finds all contents in the store
    store = source.scratch(spark, "contents")
    incremental.analyze_incremental(reviews(spark, sf_dir), store)
    return _screened(incremental.analyze_incremental(reviews(spark, sf_dir), store))


_LIST = "array_to_string({0}, ', ') as {0}".format
_EXPORT_SQL = O.with_(*O.SCREEN, O.kept("kl", O.strings(L.PROVINCES)), "types(term, k, c) as (values " + _TYPE_ROWS + ")",
    f"places as (select pos, list_sort(list(distinct term)) as location from kl join tok using (pos) where lang = 'th' and (not list_contains({_AMBIGUOUS}, term) or regexp_matches(substr(array_to_string(low, ' '), 1, s), '{L.PROVINCE_MARKER}')) group by pos)",
    "byname as (select pos, arg_min(c, p * 100 + k) as c from (select pos, c, k, instr(' ' || lower(product_name) || ' ', ' ' || term || ' ') as p from r, types) where p > 0 group by pos)",
    "bytext as (select pos, arg_min(c, s * 100 + k) as c from hit join types using (term) group by pos)",
    f"""flat as (select review_id, screen.pos, lang, review_status, credibility_score::bigint as credibility_score, overall_sentiment, coalesce(byname.c, bytext.c, '') as product_type,
    {O.gazetteer('clean_text', L.BRANDS)} as brand, {O.PRICE} as price, ({O.DAYS})::bigint as delivery_days, {O.gazetteer('clean_text', L.COURIERS)} as courier, coalesce(location, []) as location, aspects, coalesce(pros, []) as pros, coalesce(cons, []) as cons, spam_signals, clean_text, {O.SCORE} as sentiment_score, sentiment, sentiment_label, expected_aspects, case_tags, raw_text, normalized_text,
    f_url, f_email, f_line_id, f_phone, had_html, contact and promo as is_ad_spam, short or generic as is_low_quality, coalesce(dup_of, '') as duplicate_of
    from screen left join proscons using (pos) left join places using (pos) left join byname using (pos) left join bytext using (pos))""")  # fmt: skip
_ASPECT = "case when regexp_extract(sentiment, '(?:^|,){0}=([a-z]+)', 1) is null then '' else regexp_extract(sentiment, '(?:^|,){0}=([a-z]+)', 1) end as aspect_{0}".format


@query(_EXPORT_SQL + "select review_id, lang, review_status, credibility_score, overall_sentiment, sentiment_score, product_type, " + ", ".join(map(_LIST, ("brand", "courier", "location", "aspects", "pros", "cons", "spam_signals"))) + ", '' as seller_shop, price, delivery_days, clean_text, " + ", ".join(map(_ASPECT, L.ASPECT_KEYS)) + " from flat")
def flat_export(spark, sf_dir):
    out = plan.export(results(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("long") for c in ("credibility_score", "delivery_days")})


@query(_EXPORT_SQL + f"select review_id from flat where review_status in ('{L.STATUS_PASS}', '{L.STATUS_SUSPECT}') and contains(sentiment, 'shipping=')")
def browse_results(spark, sf_dir):
    return summary.browse(plan.export(results(spark, sf_dir)), [L.STATUS_PASS, L.STATUS_SUSPECT], "shipping").select("review_id")


# --- summaries ------------------------------------------------------------------------------------------------------

_OK = f"review_status <> '{L.STATUS_SPAM}'"


@query(_EXPORT_SQL + f"select count(*) as total, count(*) filter (where review_status = '{L.STATUS_PASS}') as passed, count(*) filter (where review_status = '{L.STATUS_SUSPECT}') as suspect, count(*) filter (where review_status = '{L.STATUS_SPAM}') as spam from flat")
def status_counts(spark, sf_dir):
    return summary.status_counts(results(spark, sf_dir))


_MENTIONS = f"m as (select split_part(x, '=', 1) as key, split_part(x, '=', 2) as p from (select unnest(string_split(sentiment, ',')) as x from flat where {_OK} and sentiment <> ''))"


@query(_EXPORT_SQL + "select review_status, count(*) as n, count(*) / sum(count(*)) over () as share from flat group by review_status")
def status_shares(spark, sf_dir):
    return summary.status_shares(results(spark, sf_dir))


@query(_EXPORT_SQL.rstrip() + ",\n" + _MENTIONS + ", s as (select key, count(*) as mentions, count(*) filter (where p = 'pos') as pos, count(*) filter (where p = 'neg') as neg, count(*) filter (where p = 'neutral') as neutral from m group by key)"
    + " select ord::bigint as ord, key, label, mentions, pos, neg, neutral, round_even(pos / mentions * 100, 1) as pos_pct, round_even(neg / mentions * 100, 1) as neg_pct from s join (values " + ", ".join(f"({k}, {O.quote(a)}, {O.quote(g['label'])})" for k, (a, g) in enumerate(L.ASPECTS.items())) + ") n(ord, key, label) using (key)")
def aspect_summary(spark, sf_dir):
    return summary.aspect_summary(results(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))


def _top_sql(column: str, limit: int) -> str:
    return _EXPORT_SQL.rstrip() + f",\nx as (select pos, unnest({column}) as term, unnest(range(len({column}))) as i from flat where {_OK}) select term, count(*) as n from x group by term order by n desc, min(pos * 100 + i) limit {limit}"


@query(_top_sql("pros", 8))
def top_pros(spark, sf_dir):
    return summary.top_terms(results(spark, sf_dir), "pros")


@query(_top_sql("cons", 8))
def top_cons(spark, sf_dir):
    return summary.top_terms(results(spark, sf_dir), "cons")


@query(_top_sql("brand", 6))
def top_brands(spark, sf_dir):
    return summary.top_terms(results(spark, sf_dir), "brand", 6)


@query(_top_sql("courier", 5))
def top_couriers(spark, sf_dir):
    return summary.top_terms(results(spark, sf_dir), "courier", 5)


@query(_EXPORT_SQL + f"select min(price) as min_price, max(price) as max_price from flat where {_OK} and price <> 0")
def price_range(spark, sf_dir):
    return summary.price_range(results(spark, sf_dir))


@query(_EXPORT_SQL + f"select count(*) as n, sum(delivery_days)::bigint as days, round_even(sum(delivery_days) / count(*), 1) as avg_delivery_days from flat where {_OK} and delivery_days > 0")
def delivery_average(spark, sf_dir):
    return summary.delivery_average(results(spark, sf_dir))


@query(_EXPORT_SQL + f"select k.overall_sentiment, count(flat.pos) as n from (values ('positive'), ('mixed'), ('neutral'), ('negative')) k(overall_sentiment) left join flat on flat.overall_sentiment = k.overall_sentiment and {_OK} group by 1")
def sentiment_counts(spark, sf_dir):
    return summary.sentiment_counts(results(spark, sf_dir))


# --- evaluation -----------------------------------------------------------------------------------------------------

_EXPECTED = "list_transform(list_filter(string_split(coalesce(expected_aspects, ''), '|'), lambda p: contains(p, ':')), lambda p: trim(split_part(p, ':', 1)) || '=' || trim(split_part(p, ':', 2)))"


@query(O.with_(O.R) + f"select pos, array_to_string(list_sort({_EXPECTED}), ',') as expected from r")
def parse_expected(spark, sf_dir):
    return reviews(spark, sf_dir).select("pos", pairs(evaluate.parse_expected(F.col("expected_aspects"))).alias("expected"))


_BOTH = _EXPORT_SQL.rstrip() + f""",
e as (select pos, split_part(x, '=', 1) as a, split_part(x, '=', 2) as p from (select pos, unnest({_EXPECTED}) as x from flat)),
g as (select pos, split_part(x, '=', 1) as a, split_part(x, '=', 2) as p from (select pos, unnest(string_split(sentiment, ',')) as x from flat where sentiment <> '' and pos in (select pos from e))),
j as (select coalesce(e.pos, g.pos) as pos, coalesce(e.a, g.a) as a, e.p as want, g.p as have from e full join g on e.pos = g.pos and e.a = g.a) """


_RATIOS = "select tp, fp, fn, same, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, coalesce(same / nullif(tp, 0), 0) as polarity_accuracy from o"


def _overlap_sql(where: str = "") -> str:
    return _BOTH.replace("as x from flat)),", f"as x from flat {where})),") + ", o as (select count(*) filter (where want is not null and have is not null) as tp, count(*) filter (where want is null) as fp, count(*) filter (where have is null) as fn, count(*) filter (where want = have) as same from j) "


def _expected(spark, sf_dir):
    return results(spark, sf_dir).withColumn("expected", evaluate.parse_expected(F.col("expected_aspects")))


@query(_overlap_sql() + _RATIOS)
def aspect_overlap(spark, sf_dir):
    return evaluate.aspect_overlap(_expected(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("tp", "fp", "fn", "same")})


@query(_overlap_sql(where="where lang = 'th'") + _RATIOS)
def aspect_overlap_thai(spark, sf_dir):
    return evaluate.aspect_overlap(_expected(spark, sf_dir), lang="th").withColumns({c: F.col(c).cast("long") for c in ("tp", "fp", "fn", "same")})


@query(_BOTH + "select pos, a as aspect, want as expected, have as got from j where want <> have")
def polarity_mistakes(spark, sf_dir):
    out = results(spark, sf_dir).withColumn("expected", evaluate.parse_expected(F.col("expected_aspects")))
    return evaluate.polarity_mistakes(out, "pos")


@query(_EXPORT_SQL + "select sentiment_label as label, " + ", ".join(f"count(*) filter (where overall_sentiment = '{k}') as {k}" for k in ("positive", "mixed", "neutral", "negative")) + " from flat group by 1")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(results(spark, sf_dir))


@query(_EXPORT_SQL + "select count(*) filter (where sentiment_label = overall_sentiment) as agree, count(*) as total, count(*) filter (where sentiment_label = overall_sentiment) / count(*) as share from flat where lang = 'en'")
def agreement_english(spark, sf_dir):
    return evaluate.agreement(results(spark, sf_dir), lang="en")


_DAYS_SAID = r"(?i)[0-9]+\s*(?:วัน|days?)(?:[^\p{L}\p{N}_]|$)"
_PRICE_SAID = r"(?i)(?:฿|₹|\brs\.?)\s*[0-9]|[0-9]\s*(?:บาท|\brs\b|rupees)"
# Names of the checks.
_CHECKS = [("ad_spam", "true", "is_ad_spam"), ("duplicate", "review_id not in (select duplicate_of from flat)", "duplicate_of <> ''"), ("low_quality", "true", "is_low_quality"), ("pii_phone", "true", "len(f_phone) > 0"), ("pii_line", "true", "len(f_line_id) > 0"), ("pii_url", "true", "len(f_url) > 0"), ("pii_email", "true", "len(f_email) > 0"), ("elongation", "true", "normalized_text <> clean_text"), ("delivery_days", f"regexp_matches(raw_text, '{_DAYS_SAID}')", "delivery_days is not null"), ("price", f"regexp_matches(raw_text, '{_PRICE_SAID}')", "price is not null"), ("html", "true", "had_html"), ("code_switch", "true", "len(aspects) > 0")]
# End of the fixed values.


@query(_EXPORT_SQL + " union all ".join(f"select '{t}' as tag, count(*) filter (where {h}) as hits, count(*) as total from flat where contains(case_tags, '{t}') and {a} having count(*) > 0" for t, a, h in _CHECKS))
def case_checks(spark, sf_dir):
    return evaluate.case_checks(results(spark, sf_dir))


@query(_EXPORT_SQL + "select count(*) filter (where len(aspects) = 0) as n, count(*) as total, count(*) filter (where len(aspects) = 0) / count(*) as share from flat")
def no_aspect_share(spark, sf_dir):
    return evaluate.no_aspect_share(results(spark, sf_dir))


# --- preparation ----------------------------------------------------------------------------------------------------

_B, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
_TAGS = ", ".join("case when " + (" or ".join(f"contains(lower({{x}}), '{c * 3}')" for c in "abcdefghijklmnopqrstuvwxyz") if name == "elongation" else "regexp_matches({x}, '" + p.replace("(?iu)", "(?i)").replace(sampling._B, _B).replace(sampling._E, _E).replace("{", "{{").replace("}", "}}") + "')") + f" then '{name}' end" for name, p in sampling.CASES.items())
_SIZE = "len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
_ALL = "list_filter([" + _TAGS + ", case when " + _SIZE + " <= 3 then 'low_quality' end, case when length({x}) >= 200 then 'long' end], lambda x: x is not null)"


def tags_sql(x: str) -> str:
    t = _ALL.format(x=x)
    return f"case when len({t}) >= 4 then list_append({t}, 'multi_aspect') else {t} end"


_DUMP = [f"d as ({DUMP_SQL})", f"u as (select pos, cast(Rate as int) as rate, {O.strip('Summary')} as Summary, {O.strip(O.sub(O.sub('product_name', sampling.MOJIBAKE), chr(92) + 's{2,}'))} as product_name, regexp_replace(product_price, '[^0-9.]', '', 'g') as product_price, Sentiment from d where regexp_full_match(Rate, '[1-5]') and Summary is not null and length({O.strip('Summary')}) > 0)"]


@query(O.with_(*_DUMP) + "select pos, rate::bigint as rate, Summary, product_name, product_price from u")
def clean_dump(spark, sf_dir):
    return sampling.clean_dump(dump(spark, sf_dir)).select("pos", *long("rate"), "Summary", "product_name", "product_price")


@query(O.with_(O.R) + f"select pos, {tags_sql('raw_text')} as tags from r")
def case_tags(spark, sf_dir):
    return reviews(spark, sf_dir).select("pos", sampling.case_tags(F.col("raw_text")).alias("tags"))


@query(O.with_(O.R) + "select tag, count(*) as n from (select unnest(string_split(case_tags, '|')) as tag from r) group by tag")
def tag_counts(spark, sf_dir):
    return sampling.tag_counts(reviews(spark, sf_dir))


@query("select min(length(text))::bigint as min_length, cast(floor(median(length(text))) as bigint) as median_length, max(length(text))::bigint as max_length from documents")
def length_stats(spark, sf_dir):
    return sampling.length_stats(docs(spark, sf_dir), "text").select(*long("min_length", "median_length", "max_length"))


def _balanced_sql(pool: str, n: int | str, name: str, label: str = "Sentiment", key: str = "pos") -> str:
    """CTEs of a balanced sample of a pool; n is a number or an expression."""
    per = -(-n // 3) if isinstance(n, int) else f"cast(ceil({n} / 3) as bigint)"
    h = f"sha1(concat_ws('|', cast({key} as varchar), '42'))"
    return f"""{name}_o as (select * exclude (q) from (select *, row_number() over (partition by {label} order by {h}, {key}) as q, case {label} when 'negative' then 0 when 'neutral' then 1 when 'positive' then 2 end as c from ({pool})) where c is not null and q <= {per}),
{name}_f as (select * exclude (q), 3 as c from (select *, row_number() over (order by {h}, {key}) as q from ({pool}) p where {key} not in (select {key} from {name}_o)) where q <= {per} * 3 - (select count(*) from {name}_o) and q <= {n}),
{name} as (select * exclude (c, q) from (select *, row_number() over (order by c, {h}, {key}) as q from (select * from {name}_o union all by name select * from {name}_f)) where q <= {n})"""


@query(O.with_(_balanced_sql("select l.doc_id, case l.quality + l.toxic when 0 then 'negative' when 1 then 'neutral' else 'positive' end as Sentiment, text from labels l join documents using (doc_id)", 150, "s", key="doc_id")) + "select doc_id, Sentiment as label from s")
def balanced_sample(spark, sf_dir):
    label = F.when(F.col("quality") + F.col("toxic") == 0, "negative").when(F.col("quality") + F.col("toxic") == 1, "neutral").otherwise("positive")
    rows = docs(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id", label.alias("label"))
    return sampling.balanced_sample(rows, 150, "doc_id", "label").select("doc_id", "label")


def _quota_sql() -> str:
    parts, used = [*_DUMP, f"w as (select *, array_to_string({tags_sql('Summary')}, '|') as tags from u)"], []
    for k, (tag, n, least) in enumerate(sampling.QUOTAS):
        left = "".join(f" and pos not in (select pos from q{j})" for j in used)
        parts.append(_balanced_sql(f"select * from w where contains(tags, '{tag}') and length(Summary) >= {least}{left}", n, f"q{k}"))
        used.append(k)
    left = "".join(f" and pos not in (select pos from q{j})" for j in used)
    left = "".join(f" and pos not in (select pos from q{j})" for j in used)
    taken = " + ".join(f"(select count(*) from q{k})" for k in used)
    parts.append(_balanced_sql(f"select * from w where length(Summary) between 30 and 150{left}", f"({sampling.SAMPLE_ROWS} - ({taken}))", "q8"))
    return O.with_(*parts) + " union all ".join(f"select pos, {k}::bigint as stratum from q{k}" for k in [*used, 8])


@query(_quota_sql())
def quota_sample(spark, sf_dir):
    out = sampling.quota_sample(sampling.clean_dump(dump(spark, sf_dir)), "pos", "Summary", "Sentiment")
    return out.select("pos", *long("stratum"))


@query(O.with_(*_DUMP) + "select 'EN' || lpad(cast(row_number() over (order by pos) as varchar), greatest(4, length(cast(row_number() over (order by pos) as varchar))::int), '0') as review_id, 'en' as lang, 'dump' as source, Summary as raw_text, product_name, product_price, rate::bigint as rate, Sentiment as sentiment_label, 'untagged' as case_tags, '' as expected_aspects from u")
def unified_table(spark, sf_dir):
    out = sampling.unified(sampling.clean_dump(dump(spark, sf_dir)).withColumn("tags", F.lit("")), "en", "dump", "EN", "pos")
    return out.withColumn("rate", F.col("rate").cast("long"))


@query("select doc_id as key, text from documents union all select conv_id * 1000 + turn, text from conversations")
def union_align(spark, sf_dir):
    turns = docs(spark, sf_dir, "conversations").select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("key"))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("key"), "text").unionByName(turns)


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def unlabelled(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").join(docs(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(O.with_(O.R) + "select 'R' || lpad(cast(row_number() over (order by pos) as varchar), greatest(4, length(cast(row_number() over (order by pos) as varchar))::int), '0') as review_id, pos from r")
def default_ids(spark, sf_dir):
    return plan.prepare(reviews(spark, sf_dir).select("pos", F.col("raw_text").alias("comment"))).select("review_id", "pos")


@query(O.with_(O.R) + "select review_id, raw_text from r order by pos limit 300")
def first_rows(spark, sf_dir):
    return reviews(spark, sf_dir).orderBy("pos").limit(300).select("review_id", "raw_text")


# --- corpus ---------------------------------------------------------------------------------------------------------

_WORDS = "x as (select doc_id, unnest(regexp_extract_all(text, '[a-zA-Zก-๙]+|\\p{Nd}+')) as term from documents), n as (select doc_id, term, count(*) as n from x group by 1, 2), d as (select term, count(*) as df from n group by 1), a as (select count(distinct doc_id) as nd from n), b as (select term, df, nd from d, a where df >= 2 and df <= 0.6 * nd)"


def _words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.plain_tokens(F.col("text")).alias("tokens"))


@query("with " + _WORDS + ", w as (select doc_id, term, nd, n * (ln((1 + nd) / (1 + df)) + 1) as w from n join b using (term)), l as (select doc_id, sqrt(sum(w * w)) as l from w group by 1) select term, round(m, 4) as weight from (select term, sum(w / l) / any_value(nd) as m from w join l using (doc_id) group by 1) order by m desc, term limit 15")
def tfidf(spark, sf_dir):
    return corpus.tfidf_keywords(_words(spark, sf_dir), "doc_id", "tokens")


@query("with " + _WORDS + " select doc_id, term, n from n join b using (term)")
def doc_term_counts(spark, sf_dir):
    counts, bounds = corpus.term_counts(_words(spark, sf_dir), "doc_id", "tokens")
    return counts.join(bounds.select("term"), "term").select("doc_id", "term", "n")


@query()
def lda_topics(spark, sf_dir):
    return corpus.lda_topics(tokenized(spark, sf_dir).select("pos", "tokens_clean"), "pos", "tokens_clean")[0]


@query()
def lda_assignments(spark, sf_dir):
    return corpus.lda_topics(tokenized(spark, sf_dir).select("pos", "tokens_clean"), "pos", "tokens_clean")[1]


@query("select cast(conv_id as varchar) as conv_id, cast(turn as varchar) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations")
def csv_roundtrip(spark, sf_dir):
    rows = docs(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")
    path = source.scratch(spark, "roundtrip")
    source.write_csv(rows, path)
    return source.read_csv(spark, path)


#: Cells that a strict reader takes for missing, among others.
_CELL = "case cast({0} % 4 as int) when 0 then 'NA' when 1 then '' when 2 then 'none' else {1} end"


@query("select cast(conv_id as varchar) as conv_id, case cast(turn % 4 as int) when 0 then null when 1 then null when 2 then 'none' else role end as role, nullif(text, '') as text from conversations")
def csv_strict(spark, sf_dir):
    rows = docs(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string"), F.expr(_CELL.format("turn", "role")).alias("role"), "text")
    path = source.scratch(spark, "strict")
    source.write_csv(rows, path, mark=True)
    return source.read_csv(spark, path, strict=True)


@query("with " + _VOCAB + " select word, rank from v")
def vocabulary_file(spark, sf_dir):
    path = source.scratch(spark, "vocabulary")
    source.write_vocabulary(cleanse.vocabulary(docs(spark, sf_dir), "text"), path)
    return source.read_vocabulary(spark, path).select("word", *long("rank"))


@query("select doc_id, row_number() over (order by sha1(doc_id || '|42')) - 1 as place from documents")
def shuffled(spark, sf_dir):
    # the first 60 bits of the hash that orders samples, as a number
    number = F.conv(F.substr(sampling.order_hash("doc_id"), F.lit(1), F.lit(15)), 16, 10).cast("long")
    return sampling.numbered(docs(spark, sf_dir).select("doc_id", number.alias("h")), "h", "place", ("doc_id",)).select("doc_id", *long("place"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.aspect_summary(results(spark, sf_dir))


@query(_EXPORT_SQL + "select review_id, lang, overall_sentiment, review_status, aspects, pros, cons from flat")
def analyze_batch(spark, sf_dir):
    return results(spark, sf_dir).select("review_id", "lang", "overall_sentiment", "review_status", "aspects", "pros", "cons")
