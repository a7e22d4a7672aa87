"""SQL for the operators that SQL can express."""

from .decontaminate import MIN_ITEM_WORDS, SHINGLE, THRESHOLD
from .divergence import CHAR_LIMIT, COMMON, MIN_CHARS, MIN_WORDS, WORD_LIMIT
from .packing import CAPACITY
from .suffixes import MIN_WORDS as MIN_PASSAGE

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')"


def decontamination() -> str:
    """All pairs by shared shingles."""
    k = SHINGLE
    return f"""
    with dw as (select doc_id, {_WORDS} as w from documents),
    iw as (select item_id, {_WORDS} as w from benchmark),
    i as (select distinct item_id, least({k}, len(w)) as k, unnest(list_transform(range(len(w) - least({k}, len(w)) + 1), lambda j: array_to_string(w[j + 1 : j + least({k}, len(w))], ' '))) as s from iw where len(w) >= {MIN_ITEM_WORDS}),
    ks as (select distinct k from i),
    d as (select distinct doc_id, k, unnest(list_transform(range(len(w) - k + 1), lambda j: array_to_string(w[j + 1 : j + k], ' '))) as s from dw, ks where len(w) >= k),
    n as (select item_id, count(*) as n from i group by 1),
    c as (select doc_id, item_id, count(*) as c from d join i using (k, s) group by 1, 2)
    select doc_id, item_id, c / n as containment from c join n using (item_id) where c >= greatest(1, ceil({THRESHOLD} * n))"""


def divergence() -> str:
    """Histograms of classes and common words, per document and language, and their distance."""
    classes = {"lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "space": r"[^ \t\r]", "newline": r"[^\n]", "punctuation": r"""[^.,;:''"?()\-]""", "beyond": r"[\x00-\x7F]"}
    counts = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g')) as {n}" for n, p in classes.items())
    sums = ", ".join(f"sum({n}) as {n}" for n in [*classes, "other"])
    js = "(sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end) + sum(case when q > 0 then q * log2(2 * q / (p + q)) else 0 end)) / 2"
    return f"""
    with t as (select doc_id, lang, coalesce(lang, '') as l, coalesce(text, '') as t, {_WORDS} as w from documents),
    c0 as (select doc_id, l, {counts}, length(t) as n from t),
    c as (select *, n - lower - upper - digit - space - newline - punctuation - beyond as other from c0),
    cd as (unpivot (select doc_id, l, n, lower, upper, digit, space, newline, punctuation, beyond, other from c) on lower, upper, digit, space, newline, punctuation, beyond, other into name kind value x),
    cr as (unpivot (select l, sum(n) as n, {sums} from c group by l) on lower, upper, digit, space, newline, punctuation, beyond, other into name kind value x),
    jc as (select doc_id, sqrt(least(1, greatest(0, {js}))) as j from (select cd.doc_id, cd.x / greatest(cd.n, 1) as p, cr.x / greatest(cr.n, 1) as q from cd join cr using (l, kind)) group by doc_id),
    e as (select doc_id, l, unnest(w) as word from t),
    wl as (select l, word, count(*) as n, row_number() over (partition by l order by count(*) desc, word) as r from e group by l, word),
    tl as (select l, sum(n) as total from wl group by l),
    top as (select l, word, n from wl where r <= {COMMON}),
    ref as (select l, word, n / total as q from top join tl using (l) union all select l, null, (total - s) / total from (select l, sum(n) as s from top group by l) join tl using (l)),
    ed as (select e.doc_id, e.l, top.word as word, count(*) as x from e left join top on top.l = e.l and top.word = e.word group by all),
    jw as (select doc_id, sqrt(least(1, greatest(0, {js}))) as j from
        (select t.doc_id, coalesce(ed.x, 0) / greatest(len(t.w), 1) as p, ref.q as q from t join ref using (l) left join ed on ed.doc_id = t.doc_id and ed.word is not distinct from ref.word) group by doc_id),
    r as (select t.doc_id, t.lang, case when length(t) >= {MIN_CHARS} and len(w) >= {MIN_WORDS} then jc.j end as a,
        case when length(t) >= {MIN_CHARS} and len(w) >= {MIN_WORDS} then jw.j end as b
        from t left join tl using (l) left join jc using (doc_id) left join jw using (doc_id))
    select doc_id, lang, round(a, 6) as char_distance, round(b, 6) as word_distance from r where a is null or a <= {CHAR_LIMIT} and b <= {WORD_LIMIT}"""


def suffixes() -> str:
    """All runs of MIN_WORDS words by their text, and islands of positions that follow each other like their sources."""
    n = MIN_PASSAGE
    return f"""
    with t as (select doc_id, {_WORDS} as w from documents),
    p as (select doc_id, unnest(range(len(w) - {n} + 1)) as pos, w from t where len(w) >= {n}),
    k as (select doc_id, pos, md5(array_to_string(w[pos + 1 : pos + {n}], ' ')) as k from p),
    s as (select *, count(*) over (partition by k) as n, first_value(doc_id) over o as source_id, first_value(pos) over o as source_word, row_number() over o = 1 as is_source from k window o as (partition by k order by doc_id nulls last, pos)),
    i as (select *, pos - row_number() over (partition by doc_id, source_id, pos - source_word, is_source order by pos) as island from s where n > 1)
    select doc_id, min(pos)::bigint as start_word, (count(*) + {n} - 1)::bigint as n_words, source_id, min(source_word)::bigint as source_word, is_source from i group by doc_id, source_id, pos - source_word, is_source, island"""


def packing_holds() -> str:
    """Words and pieces of every document that has words, and nothing wrong."""
    return f"""
    with n as (select doc_id, length(regexp_extract_all(coalesce(text, ''), '\\S+')) as n from documents)
    select doc_id, sum(n)::bigint as words, sum(ceil(n / {CAPACITY}))::bigint as pieces, 0::bigint as wrong from n where n > 0 group by doc_id"""


def sharding_holds() -> str:
    return "select doc_id, lang, source, n_chars, count(*) as n, 0::bigint as gaps from documents group by all"
