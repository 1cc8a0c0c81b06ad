"""SQL for DuckDB with the same results as the queries of this folder, where SQL can express them on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower(nfc_normalize({})), '[\p{{L}}\p{{N}}]+')"
_TEXT = "array_to_string(list_transform(conversations, lambda t: t.value_text), chr(10))"

_PAIRS = rf"""with a as (select id, list_distinct({_WORDS.format(_TEXT)}) as w from train_total), b as (select id, list_distinct({_WORDS.format(_TEXT)}) as w from test_total),
x as (select id, len(w) as n, unnest(w) as w from a), y as (select id, len(w) as n, unnest(w) as w from b),
c as (select x.id as train_id, y.id as test_id, x.n as n, y.n as m, count(*) as common from x join y using (w) where x.n >= 0.8 * y.n and y.n >= 0.8 * x.n group by all)
select train_id, test_id from c where common >= 0.8 * (n + m - common)"""

_LEAKS = rf"""with d as (select doc_id, {_WORDS.format("text")} as w from documents), p as (select item_id, {_WORDS.format("passage")} as w from eval_passages),
dw as (select doc_id, array_to_string(w[i : i + 11], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
pw as (select item_id, array_to_string(w[i : i + 11], ' ') as s from (select item_id, w, unnest(range(1, len(w) - 10)) as i from p))
select distinct doc_id, item_id from dw join pw using (s)"""

SQL: dict[str, str] = {
    "p2_found": _PAIRS,
    "p2_counts": f"select split, dataset, count(*) as records, sum(n)::bigint as pairs from (select test_id, count(*) as n from ({_PAIRS}) group by test_id) f join test_total t on t.id = f.test_id group by split, dataset",
    "p7_found": _LEAKS,
    "p7_items": f"select p.item_id, count(f.doc_id) as documents from eval_passages p left join ({_LEAKS}) f using (item_id) group by p.item_id",
}
