"""SQL that checks the review queries: the same results by joins, unnesting and windows in another engine."""

from __future__ import annotations

from opinara.functions import lexicon as L
from opinara.plans.analyze import TERMS
from opinara.plans.synthetic import REVIEWS_SQL


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strings(xs) -> str:
    return "[" + ", ".join(map(quote, xs)) + "]"


# Patterns that decide what is found, without look-around.
TAG, ENTITY = r"<[^>]+>", r"(?i)&[a-z]+;|&#\p{Nd}+;"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]+"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
URL = r"(?i)(?:https?://|www\.)[^\s<>\"'']+"
LINE = r"(?i)(?:(?:line|ไลน์|ไอดีไลน์|ไอดี)\s*(?:id)?\s*[:：]?\s*@?[\p{L}\p{N}_.\-]{3,})|(?:@[\p{L}\p{N}_.\-]{3,})"
SOCIAL = r"(?i)(?:facebook|fb|ig|instagram|tiktok|whatsapp)\s*[:：]?\s*[\p{L}\p{N}_.\-]{3,}"
PHONE = r"0\p{Nd}[\p{Nd}\-\s]{7,12}\p{Nd}"
#: Numbers that begin and end with a digit are told from longer ones by the characters around them.
PHONE_OUT = r"(^|[^\p{Nd}])0\p{Nd}[\p{Nd}\-\s]{7,12}\p{Nd}($|[^\p{Nd}])"
# End of the fixed values.


def sub(x: str, pattern: str, by: str = "' '") -> str:
    return f"regexp_replace({x}, '{pattern}', {by}, 'g')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def language(x: str) -> str:
    thai, letters = f"length({sub(x, '[^ก-๙]', repr(''))})", f"length({sub(x, '[^ก-๙a-zA-Z]', repr(''))})"
    return f"case when {letters} > 0 and {thai} / {letters} >= 0.15 then 'th' else 'en' end"


def blank(x: str, pattern: str) -> str:
    return f"(select coalesce(string_agg(g || repeat(' ', coalesce(length(h), 0)), '' order by k), '') from (select unnest(string_split_regex({x}, '{pattern}')) as g, unnest(regexp_extract_all({x}, '{pattern}')) as h, unnest(range(len(string_split_regex({x}, '{pattern}')))) as k))"


def finds(x: str, pattern: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '{pattern}'), lambda h: {strip('h')})))"


def collapse(x: str) -> str:
    """Runs of three and more, by comparing each character with its neighbours."""
    cs = f"string_split({x}, '')"
    latin = f"regexp_matches(c, '[a-zA-Z]') and {cs}[i - 1] is not distinct from c and {cs}[i - 2] is not distinct from c and i > 2"
    other = f"not regexp_matches(c, '[a-zA-Z\\s]') and i > 1 and {cs}[i - 1] is not distinct from c and ({cs}[i + 1] is not distinct from c or (i > 2 and {cs}[i - 2] is not distinct from c))"
    return f"array_to_string(list_filter({cs}, lambda c, i: not ({latin}) and not ({other})), '')"


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fingerprint(x: str) -> str:
    core = sub(f"lower({x})", r"[^\p{L}\p{N}_ก-๙]+", "''")
    return f"sha1({core})"


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


R = f"r as ({REVIEWS_SQL})"
R2 = f"r2 as (select * replace ({strip('raw_text')} as raw_text) from r)"
#: Step by step: markup out, emoji out, contacts looked for with finds blanked, contacts removed.
CLEAN = [
    R, R2,
    f"c1 as (select *, {language('raw_text')} as lang, regexp_matches(raw_text, '{TAG}') or regexp_matches(raw_text, '{ENTITY}') as had_html, {sub(sub('raw_text', TAG), ENTITY)} as t1 from r2)",
    f"c2 as (select *, length(t1) - length({sub('t1', EMOJI, repr(''))}) as emoji_count, {sub('t1', EMOJI)} as t2 from c1)",
    f"c3 as (select *, {finds('t2', URL)} as f_url, {sub('t2', URL)} as m1 from c2)",
    f"c4 as (select *, {finds('m1', EMAIL)} as f_email, {sub('m1', EMAIL)} as m2 from c3)",
    f"c5 as (select *, {finds('m2', LINE)} as f_line_id, {sub('m2', LINE)} as m3 from c4)",
    f"c6 as (select *, {finds('m3', SOCIAL)} as f_social, {sub('m3', SOCIAL)} as m4 from c5)",
    f"c7 as (select *, list_sort(list_distinct(list_filter(regexp_extract_all(m4, '{PHONE}'), lambda h: regexp_matches(h, '^{PHONE}$')))) as f_phone from c6)",
    "c8 as (select *, " + sub(sub(sub(sub(f"regexp_replace(t2, '{PHONE_OUT}', '\\1 \\2', 'g')", EMAIL), URL), LINE), SOCIAL) + " as t3 from c7)",
    f"clean as (select *, {strip(sub('t3', chr(92) + 's{2,}'))} as clean_text from c8)",
]
NORMAL = [*CLEAN, f"normal as (select *, translate({collapse('clean_text')}, '{UPPER}', '{UPPER.lower()}') as normalized_text from clean)"]


def _parts(name: str, source: str, column: str, where: str = "") -> str:
    """Runs of letters and the gaps before them, one row each."""
    gaps, runs = f"regexp_split_to_array({column}, '[a-zA-Z]+')", f"regexp_extract_all({column}, '[a-zA-Z]+')"
    return f"{name} as (select pos, g[k + 1] as gap, m[k + 1] as w, k from (select pos, {gaps} as g, {runs} as m, unnest(range(len({gaps}))) as k from {source} {where}))"


def mended(words: list[str]) -> list[str]:
    """NORMAL with the words of a vocabulary, most frequent first: glued English words cut, doubled letters made single."""
    single = "lower(w)"
    for c in UPPER.lower():
        single = f"regexp_replace({single}, '{c}{c}', '{c}', 'g')"
    return [
        *CLEAN[:-1],
        "v(word, rank) as (values " + ", ".join(f"({quote(w)}, {k})" for k, w in enumerate(words)) + ")",
        _parts("glued", "c8", "t3", "where lang = 'en'"),
        "alone as (select distinct lower(w) as low from glued where length(w) >= 5 and lower(w) not in (select word from v))",
        "cuts as (select low, unnest(range(2, length(low) - 1)) as i from alone)",
        "best as (select low, arg_min(substr(low, 1, i) || ' ' || substr(low, i + 1), (a.rank + b.rank) * 100 + i) as two from cuts join v a on a.word = substr(low, 1, i) join v b on b.word = substr(low, i + 1) group by low)",
        "apart as (select pos, string_agg(gap || coalesce(two, w, ''), '' order by k) as t4 from glued left join best on best.low = lower(glued.w) and length(glued.w) >= 5 group by pos)",
        f"clean as (select c8.*, {strip(sub('coalesce(t4, t3)', chr(92) + 's{2,}'))} as clean_text from c8 left join apart using (pos))",
        f"n1 as (select *, {collapse('clean_text')} as t5 from clean)",
        _parts("doubled", "n1", "t5"),
        f"single as (select *, {single} as s from doubled)",
        "halved as (select pos, string_agg(gap || case when w is null then '' when lower(w) in (select word from v) then w when s in (select word from v) then s else w end, '' order by k) as t6 from single group by pos)",
        f"normal as (select n1.*, translate(coalesce(t6, t5), '{UPPER}', '{UPPER.lower()}') as normalized_text from n1 left join halved using (pos))",
    ]


_TYPOS = "map(" + strings(L.TYPO_MAP) + ", " + strings(L.TYPO_MAP.values()) + ")"
_PLAIN = r"[a-zA-Zก-๙]+|\p{Nd}+"
_SPACED = r"[ก-๙]+|[a-zA-Z]+|[0-9]+|[^\sก-๙a-zA-Z0-9]"
_LOW = "lower(t)"
TOKENS = [
    *NORMAL,
    f"tok1 as (select *, case when lang = 'th' then regexp_extract_all(normalized_text, '{_SPACED}') else regexp_extract_all(normalized_text, '{_PLAIN}') end as w from normal)",
    f"tok2 as (select *, list_filter(list_transform(w, lambda t: coalesce({_TYPOS}[t], t)), lambda t: t <> '') as tokens from tok1)",
    f"tok as (select *, list_filter(tokens, lambda t: list_contains({strings(L.protected_words())}, t) or list_contains({strings(L.protected_words())}, lower(t)) or (not list_contains({strings(L.STOPWORDS_EN)}, lower(t)) and not list_contains({strings(L.STOPWORDS_TH)}, t) and (length(t) >= 2 or regexp_matches(t, '[ก-๙]')) and regexp_matches(t, '[a-zA-Zก-๙0-9]'))) as tokens_clean, list_transform(tokens, lambda t: lower(t)) as low from tok2)",
]
_THAI = "[ก-๙]"
_LEX = "(values " + ", ".join(f"({quote(t)}, {k}, {quote(t.lower().replace(' ', '')) if any('ก' <= c <= '๙' for c in t) else quote(t.lower())}, {'true' if any('ก' <= c <= '๙' for c in t) else 'false'}, {len(t.split())})" for k, t in enumerate(TERMS)) + ")"


def lists(name: str, rows: list[tuple]) -> str:
    return f"{name} as (select * from (values " + ", ".join("(" + ", ".join(quote(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows) + ")"


HITS = [
    *TOKENS,
    f"lex(term, ord, key, thai, n) as (select * from {_LEX})",
    "spot as (select pos, low, unnest(range(1, len(low) + 1)) as i from tok)",
    "place as (select *, case when i = 1 then 0 else length(array_to_string(low[1:i - 1], ' ')) + 1 end as s from spot)",
    "runs as (select pos, s, n, array_to_string(low[i:i + n - 1], ' ') as run from place, (values (1), (2), (3), (4)) v(n) where i + n - 1 <= len(low))",
    "plain as (select pos, s, s + length(run) as e, term, ord from runs join lex on run = key and not thai and lex.n = runs.n)",
    f"suffix as (select pos, i, low, s, array_to_string(low[i:], '') as rest from place where regexp_matches(low[i], '^{_THAI}'))",
    "thai as (select pos, s, s + length(key) + len(list_filter(range(i, len(low) + 1), lambda j: length(array_to_string(low[i:j], '')) < length(key))) as e, term, ord from suffix join lex on thai and starts_with(rest, key))",
    "hit as (select * from plain union all select * from thai)",
]


def kept(name: str, terms: str) -> str:
    """The hits of some terms that lie in no earlier or longer one."""
    return f"{name} as (select pos, s, e, term, ord from (select *, max(e) over (partition by pos order by s, e desc, ord rows between unbounded preceding and 1 preceding) as before from hit where list_contains({terms}, term)) where before is null or before < e)"


_NEG = r"(?:" + "|".join(L.NEGATIONS) + r")\s*\S*\s*$"


def negated(s: str) -> str:
    return f"regexp_matches(substr(array_to_string(low, ' '), greatest({s} - {L.NEGATION_WINDOW}, 0) + 1, least({s}, {L.NEGATION_WINDOW})), '{_NEG}')"


ASPECTS = [
    *HITS,
    kept("ka", strings(dict.fromkeys(t for t, *_ in L.aspect_terms()))),
    kept("kg", strings(t for t, _ in L.general_terms())),
    "al(term, aspect, aord, p) as (values " + ", ".join(f"({quote(t)}, {quote(a)}, {o}, {p})" for t, a, o, p in L.aspect_terms()) + ")",
    "gl(term, p) as (values " + ", ".join(f"({quote(t)}, {p})" for t, p in L.general_terms()) + ")",
    f"pair as (select pos, s, e, term, aspect, aord, p * case when {negated('s')} then -1 else 1 end as p, row_number() over (partition by pos order by s, e desc, ord, aord) as k from ka join al using (term) join tok using (pos))",
    "rank as (select pos, aspect, row_number() over (partition by pos order by min(k)) as rank from pair group by pos, aspect)",
    f"gen as (select kg.pos, s, e, term, gl.p * case when {negated('s')} then -1 else 1 end as p from kg join gl using (term) join tok using (pos) where not exists (select 1 from pair where pair.pos = kg.pos and pair.s <= kg.s and kg.s < pair.e))",
    f"near as (select pos, gs, p, arg_min(aspect, gap * 1000000 + rank * 10000) as aspect from (select gen.pos, gen.s as gs, gen.p, pair.aspect, rank.rank, case when pair.s > gen.e then pair.s - gen.e else gen.s - pair.e end as gap from gen join pair on gen.pos = pair.pos join rank on rank.pos = pair.pos and rank.aspect = pair.aspect) where gap between 0 and {L.POLARITY_WINDOW - 1} group by pos, gs, p)",
    "score as (select pos, aspect, rank, 2 * coalesce((select sum(p) from pair where pair.pos = rank.pos and pair.aspect = rank.aspect), 0) + coalesce((select sum(p) from near where near.pos = rank.pos and near.aspect = rank.aspect), 0) as s2 from rank)",
    "gsum as (select pos, sum(p) as g from gen group by pos)",
    "asum as (select pos, sum(s2) as total, sum(abs(s2)) as size, bool_or(s2 > 0) as up, bool_or(s2 < 0) as down, list(aspect order by rank) as aspects, string_agg(aspect || '=' || case when s2 > 0 then 'pos' when s2 < 0 then 'neg' else 'neutral' end, ',' order by aspect) as sentiment from score group by pos)",
    "opinion as (select tok.pos, coalesce(total, 0) + coalesce(g, 0) as total, coalesce(size, 0) + abs(coalesce(g, 0)) as size, coalesce(up, false) as up, coalesce(down, false) as down, coalesce(aspects, []) as aspects, coalesce(sentiment, '') as sentiment from tok left join asum using (pos) left join gsum using (pos))",
    "mood as (select *, case when up and down then 'mixed' when up or total > 0 then 'positive' when down or total < 0 then 'negative' else 'neutral' end as overall_sentiment from opinion)",
    "side as (select pair.pos, term, p > 0 as good, min(rank.rank * 100000 + k) as o from pair join rank on rank.pos = pair.pos and rank.aspect = pair.aspect where p <> 0 group by pair.pos, term, p > 0)",
    "pick as (select pos, term, good, row_number() over (partition by pos, good order by o) as j from side a where not exists (select 1 from side b where b.pos = a.pos and b.good = a.good and b.term <> a.term and contains(b.term, a.term)))",
    "proscons as (select pos, coalesce(list(term order by j) filter (where good and j <= 8), []) as pros, coalesce(list(term order by j) filter (where not good and j <= 8), []) as cons from pick group by pos)",
]
_GENERIC = "lower(search)"
for _p in L.GENERIC_PHRASES:
    _GENERIC = f"replace({_GENERIC}, {quote(_p)}, ' ')"
SCREEN = [
    *ASPECTS,
    f"dup as (select pos, case when first_value(pos) over w < pos then first_value(review_id) over w end as dup_of from r2 window w as (partition by {fingerprint('raw_text')} order by pos))",
    kept("kp", strings(L.PROMO_KEYWORDS)),
    "promo as (select distinct pos, true as promo from kp)",
    "said as (select pos, list(term order by s, e desc, ord)[1:3] as promos from kp group by pos)",
    "s1 as (select tok.*, mood.* exclude (pos), dup_of, promos, list_filter([case when len(f_url) > 0 then 'url' end, case when len(f_email) > 0 then 'email' end, case when len(f_line_id) > 0 then 'line_id' end, case when len(f_social) > 0 then 'social' end, case when len(f_phone) > 0 then 'phone' end], lambda x: x is not null) as kinds, coalesce(promo.promo, false) as promo, len(f_url) + len(f_email) + len(f_line_id) + len(f_social) + len(f_phone) > 0 as contact, coalesce(nullif(array_to_string(tokens, ' '), ''), clean_text) as search from tok join mood using (pos) join dup using (pos) left join promo on promo.pos = tok.pos left join said on said.pos = tok.pos)",
    f"s2 as (select *, len(tokens_clean) < {L.MIN_TOKENS} and len(aspects) = 0 as short, len(tokens_clean) <= 6 and len(regexp_extract_all({_GENERIC}, '[a-zA-Zก-๙]{{2,}}')) <= 1 as generic, emoji_count > 0 and not regexp_matches(search, '[a-zA-Zก-๙]') as emoji from s1)",
    "s3 as (select *, greatest(0, least(100, 100 - case when contact and promo then 70 when contact then 15 when promo then 10 else 0 end - case when short then 35 else 0 end - case when generic and not short then 10 else 0 end - case when dup_of is not null then 30 else 0 end - case when len(aspects) = 0 and not short then 10 else 0 end - case when emoji then 35 else 0 end)) as credibility_score from s2)",
    f"screen as (select *, case when credibility_score >= {L.PASS} then '{L.STATUS_PASS}' when credibility_score >= {L.SUSPECT} then '{L.STATUS_SUSPECT}' else '{L.STATUS_SPAM}' end as review_status, list_filter([case when contact then 'contains_contact' end, case when promo then 'promo_keyword' end, case when short then 'too_short' end, case when generic and not short then 'generic_phrase' end, case when dup_of is not null then 'duplicate' end, case when len(aspects) = 0 and not short then 'no_aspect' end, case when emoji then 'emoji_only' end], lambda x: x is not null) as spam_signals from s3)",
]


#: Over ``mood``: the score; over ``screen``: reasons with their penalties.
SCORE = "case when size > 0 then round_even(total / size, 3) else 0.0 end"
REASONS = (
    "list_filter([case when contact and promo then 'contact with promotion/70' when contact then 'contact: ' || array_to_string(kinds, ', ') || '/15' when promo then 'promotion: ' || array_to_string(promos, ', ') || '/10' end, "
    "case when short then 'words: ' || len(tokens_clean) || '/35' end, case when generic and not short then 'generic phrase/10' end, case when dup_of is not null then 'same as ' || dup_of || '/30' end, "
    "case when len(aspects) = 0 and not short then 'no aspect/10' end, case when emoji then 'emoji only/35' end], lambda x: x is not null)"
)


def number(x: str) -> str:
    return f"try_cast(replace({x}, ',', '') as double)"


# Patterns that decide what is found, without look-around.
_PRICE = r"(?i)(?:฿|₹|\b(?:rs|inr|thb)\.?)\s*([0-9,]+(?:\.[0-9]+)?)|([0-9,]+(?:\.[0-9]+)?)\s*(?:บาท|฿|₹|\b(?:thb|rs|inr|rupees?)\b)"
PRICE = number(f"coalesce(nullif(regexp_extract(clean_text, '{_PRICE}', 1), ''), nullif(regexp_extract(clean_text, '{_PRICE}', 2), ''))")
_DAYS = r"(?i)([0-9]{1,3})\s*(?:วัน|วันทำการ|days?|day)"
DAYS = f"list_min(list_filter(list_transform(regexp_extract_all(normalized_text, '{_DAYS}', 1), lambda x: cast(x as int)), lambda d: d between 1 and 60))"
_STAR = r"(?i)([0-9](?:\.[0-9])?)\s*(?:ดาว|stars?|/\s*5|เต็ม\s*5)"
STARS = f"case when try_cast(nullif(regexp_extract(clean_text, '{_STAR}', 1), '') as double) between 0 and 5 then try_cast(nullif(regexp_extract(clean_text, '{_STAR}', 1), '') as double) end"
_VAR = r"(?i)(?:สี|ไซส์|ไซซ์|ขนาด|รุ่น|size|colou?r|model)\s*[:：]?\s*([\p{L}\p{N}_ก-๙]{1,15})"
# End of the fixed values.


def gazetteer(x: str, terms: list[str]) -> str:
    """Every term on its own, then those inside longer ones at the same place out; names here overlap only by containment."""
    longest = sorted(terms, key=len, reverse=True)
    plain = [t for t in longest if not any("ก" <= c <= "๙" for c in t)]
    pattern = r"(?i)(?:" + "|".join(t.replace("&", r"\&") for t in plain) + r")"
    once = f"list_filter(regexp_extract_all(' ' || {x} || ' ', '(?i)[^\\p{{L}}\\p{{N}}_](' || '{pattern[4:]}' || ')(?:[^\\p{{L}}\\p{{N}}_])', 1), lambda h: h <> '')"
    names = "map(" + strings(t.lower() for t in terms) + ", " + strings(terms) + ")"
    return f"list_sort(list_distinct(list_transform({once}, lambda h: {names}[lower(h)])))"
