"""SQL that states the results of this subpackage's queries, where SQL can."""

from __future__ import annotations

from tessera.llm import quality
from tessera.llm.queries import SHARDS

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for x in quality.STOP_WORDS.values() for w in x}))
    by = {"few_words": "n_words < 50", "repetition": "100 * n_repeat_words > 50 * n_words"}
    ratio = {
        "mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words", "stop_word_ratio": "n_stop_words / n_words",
        "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)",
    }
    tests = [f"({ratio[r.metric]}) {op} {bound}" for r in quality.RULES for op, bound in (("<", r.least), (">", r.most)) if bound is not None]
    return rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
w as (select k, doc_id, t, regexp_extract_all(t, '{_WORD}') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from d),
win as (select k, unnest(range(1, len(words) - 1)) as p, words from w where len(words) >= 3),
named as (select k, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] as x from win),
twice as (select k, x from named group by all having count(*) > 1),
covered as (select k, count(distinct q) as n from (select k, unnest([p, p + 1, p + 2]) as q from named join twice using (k, x)) group by k),
m as (
  select w.k, doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
    len(list_filter(words, lambda x: lower(rtrim(x, '.,;:!?')) in ({stop})))::bigint as n_stop_words
  from w left join covered on w.k = covered.k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, ({by["few_words"]} or {by["repetition"]}) as base_failed,
  case when {by["few_words"]} or {by["repetition"]} then false else not ({" or ".join(tests)}) end as kept
from m"""


def _filled(shards: list[str], size: int) -> list[int]:
    """The lookup table by its definition: whole preference lists, and turns."""
    import hashlib

    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    prefer = [iter([(number(f"offset:{s}") + j * (number(f"skip:{s}") % (size - 1) + 1)) % size for j in range(size)]) for s in shards]
    owner: dict[int, int] = {}
    turn = 0
    while len(owner) < size:
        owner.setdefault(next(x for x in prefer[turn % len(shards)] if x not in owner), turn % len(shards))
        turn += 1
    return [owner[k] for k in range(size)]


def _sharding() -> str:
    table = _filled(SHARDS, 65537)
    return f"""
with t as (select unnest(range(65537)) as slot, unnest(string_split('{",".join(map(str, table))}', ','))::int as shard),
p as (select doc_id, source, (('0x' || md5(coalesce(doc_id::varchar, ''))[1:15])::bigint % 65537)::int as slot from documents)
select doc_id, source, p.slot, shard, format('shard-{{:03d}}', shard) as shard_name from p join t on p.slot = t.slot"""


#: Calls, answers, links, problems and JSON by their definition, from the plain turns.
_CHAT = """
with c as (
  select *, length(text) as n, case turn % 3 when 0 then 'search' when 1 then 'calculator' else 'lookup' end as tool,
    case role when 'user' then 'call' when 'assistant' then 'result' else 'message' end as kind,
    'c' || case role when 'user' then turn % 4 when 'assistant' then (turn + 3) % 4 end as id
  from conversations),
spans as (
  select conv_id, id, turn, lag(turn) over w as earlier, lead(turn) over w as later
  from (select distinct conv_id, id, turn from c where kind = 'call' and conv_id is not null) window w as (partition by conv_id, id order by turn)),
met as (
  select c.conv_id, c.id, c.turn, s.turn as owner from c join spans s on c.kind = 'result' and c.conv_id = s.conv_id and c.id = s.id
    and (s.earlier is null or c.turn > s.turn) and (s.later is null or c.turn <= s.later)),
firsts as (select conv_id, id, owner, min(turn) as first from met group by all),
j as (
  select c.*, met.owner, firsts.first, answered.owner is not null as got,
    case when n is null then [] when tool = 'search' and n % 2 = 1 then ['limit is not of type integer'] when tool = 'calculator' and n % 5 = 0 then ['unexpected precise']
      when tool = 'lookup' then ['unknown tool'] else [] end
      || case when text is null and tool = 'lookup' then ['unknown tool'] when text is null then ['missing ' || case tool when 'search' then 'query' else 'expression' end] else [] end as problems,
    case when text is null then '{}' when tool = 'calculator' then '{"expression":' || to_json(text) || case when n % 5 = 0 then ',"precise":true}' else '}' end
      when tool = 'search' and n % 2 = 1 then '{"limit":"all","query":' || to_json(text) || '}' when n % 2 = 1 then '{"query":' || to_json(text) || '}'
      else '{"limit":' || n || ',"query":' || to_json(text) || '}' end as arguments
  from c left join (select distinct * from met) met on c.kind = 'result' and c.conv_id = met.conv_id and c.turn = met.turn and c.id = met.id
    left join firsts on met.conv_id = firsts.conv_id and met.id = firsts.id and met.owner = firsts.owner
    left join firsts answered on c.kind = 'call' and c.conv_id = answered.conv_id and c.id = answered.id and c.turn = answered.owner)
select conv_id, turn, role, kind, coalesce(owner, turn) as order_turn, (owner is not null)::int as order_depth, (kind = 'call')::int as n_calls,
  (kind = 'call' and problems = [])::int as n_valid_calls, (kind = 'call' and conv_id is not null and not got)::bigint as n_unanswered, owner is not null as linked,
  case when kind = 'call' then array_to_string(list_transform(problems, lambda p: id || ': ' || p), '; ') when kind = 'result' and owner is null then id || ': no such call'
    when kind = 'result' and turn > first then id || ': answered before' else '' end as errors,
  '{' || array_to_string(list_filter([
    case when text is not null then '"content":' || to_json(text) end, case when role is not null then '"role":' || to_json(role) end,
    case when kind = 'result' then '"tool_call_id":"' || id || '"' end,
    case when kind = 'call' then '"tool_calls":[{"arguments":' || to_json(arguments::varchar) || ',"id":"' || id || '","name":"' || tool || '"}]' end], lambda x: x is not null), ',') || '}' as message_json
from j"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _CHAT, "op8_quality_rules": _quality(), "op9_sharding": _sharding()}
