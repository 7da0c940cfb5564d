"""SQL for DuckDB that computes the registered queries by other means: RE2 patterns as they stand, window sums for
offsets, a recursive query for the overlap fold, dense ranks for placeholders, string aggregation for masking."""

from __future__ import annotations

from redactlake import fixed_values as fv
from redactlake.plans import planted
from redactlake.plans.queries import CALLS, ENTRIES, POLICY_JSON, TOKENS, TOP_DOCUMENTS, WAVE, WHITELIST


BOUNDARY = r"\b"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits(name: str, source: str, pattern: str, needs: str = "true") -> str:
    """CTEs for all matches of a pattern: scan_id, i, text, start, cstart (bytes, characters), before, after.

    ``needs`` is implied by a match and only saves time.
    """
    re = lit(f"({pattern})")
    return f"""
{name}_p as (
  select scan_id, whole, unnest(pieces) as piece, generate_subscripts(pieces, 1) as i from (
    select scan_id, text as whole, string_split(regexp_replace(text, {re}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) as pieces
    from {source} where {needs} and regexp_matches(text, {re}))),
{name} as (
  select scan_id, i, piece as text, start, cstart, case when cstart > 0 then substr(whole, cstart, 1) else '' end as before,
    substr(whole, cstart + length(piece) + 1, 1) as after
  from (select *, coalesce(sum(strlen(piece)) over w, 0)::bigint as start, coalesce(sum(length(piece)) over w, 0)::bigint as cstart
        from {name}_p window w as (partition by scan_id order by i rows between unbounded preceding and 1 preceding))
  where i % 2 = 0)"""


def digits(expr: str) -> str:
    return f"regexp_replace({expr}, '[^0-9]', '', 'g')"


def numbers(expr: str) -> str:
    return f"list_transform(string_split({expr}, ''), lambda c: c::int)"


LUHN = (
    "list_sum(list_transform(range(1, length(d) + 1), lambda j: case when (length(d) - j) % 2 = 0 then substr(d, j, 1)::int"
    " when substr(d, j, 1)::int > 4 then substr(d, j, 1)::int * 2 - 9 else substr(d, j, 1)::int * 2 end)) % 10 = 0"
)


def detectors(source: str, types: list[str]) -> tuple[str, str]:
    """CTEs and the union of candidates: scan_id, pii_type, start, cstart, text, confidence, rule_id, seq."""
    ctes, selects = [], []

    def add(
        pii_type, name, pattern, confidence, needs="true", where="true", text="text", rule="null", shift="0", cshift="0", frm=None
    ):
        ctes.append(hits(name, source, pattern, needs))
        ordinal = fv.PII_TYPES.index(pii_type)
        selects.append(
            f"select scan_id, '{pii_type}' as pii_type, (start + {shift})::bigint as start, (cstart + {cshift})::bigint as cstart, "
            f"{text} as text, ({confidence})::double as confidence, {rule}::varchar as rule_id, {fv.PRIORITY[pii_type]} as prio, "
            f"{ordinal} as ordinal, {len(selects)}::bigint * 1000000000 + i as seq from {frm or name} where {where}"
        )

    def wanted(t: str) -> bool:
        return t in types

    if wanted("SECRET"):
        for n, (rule, pattern, literals, confidence) in enumerate(fv.SECRET_RULES):
            needs = " or ".join(f"contains(text, {lit(x)})" for x in literals)
            value = f"regexp_extract(text, {lit(pattern)}, 1)" if rule == "jwt" else "text"
            add(
                "SECRET", f"h_secret{n}", pattern, confidence, needs=f"({needs})", rule=lit(rule), text=value,
                shift=f"strlen(text) - strlen({value})", cshift=f"length(text) - length({value})",
            )
        value = f"regexp_extract(text, {lit(fv.GENERIC_SECRET.replace(BOUNDARY, '', 1))}, 1)"
        add(
            "SECRET", "h_generic", fv.GENERIC_SECRET, fv.GENERIC_SECRET_CONFIDENCE, text=value, rule=lit(fv.GENERIC_SECRET_RULE),
            shift=f"strlen(text) - strlen({value})", cshift=f"length(text) - length({value})",
        )
    if wanted("URL_SECRET"):
        value = f"regexp_extract(text, {lit(fv.URL_SECRET)}, 1)"
        add(
            "URL_SECRET", "h_url", fv.URL_SECRET, fv.URL_SECRET_CONFIDENCE, text=value,
            shift=f"strlen(text) - strlen({value})", cshift=f"length(text) - length({value})",
        )
    if wanted("EMAIL"):
        add("EMAIL", "h_email", fv.EMAIL, 1.0, needs="contains(text, '@')")
    if wanted("PHONE"):
        add(
            "PHONE", "h_phone", fv.PHONE, 1.0,
            where=f"length({digits('text')}) >= 9 and not regexp_matches(before, '[0-9+]') and not regexp_matches(after, '[0-9]')",
        )
    if wanted("CREDIT_CARD"):
        ctes_before = len(ctes)
        add(
            "CREDIT_CARD", "h_card", fv.CREDIT_CARD,
            "case when luhn and grouped then 1.0 when grouped then 0.6 else 0.9 end",
            where="(luhn or grouped) and not regexp_matches(before, '[0-9]') and not regexp_matches(after, '[0-9]')",
            frm="h_card_checked",
        )
        assert len(ctes) == ctes_before + 1
        ctes.append(
            f"h_card_checked as (select *, {LUHN} as luhn, regexp_matches(text, '[ -]') as grouped from "
            f"(select *, {digits('text')} as d from h_card))"
        )
    if wanted("IBAN"):
        add(
            "IBAN", "h_iban", fv.IBAN, "case when rest = 1 then 1.0 else 0.6 end", text="rtrim(text, ' ')",
            where="want = length(code)", frm="h_iban_checked",
        )
        table = ", ".join(f"('{c}', {n})" for c, n in fv.IBAN_LENGTHS.items())
        number = (
            "array_to_string(list_transform(string_split(substr(code, 5) || substr(code, 1, 4), ''), "
            "lambda c: case when c between '0' and '9' then c else (ord(c) - 55)::varchar end), '')"
        )
        ctes.append(
            f"h_iban_checked as (select h.*, list_reduce({numbers(number)}, lambda a, b: (a * 10 + b) % 97) as rest, "
            "l.want from (select *, replace(text, ' ', '') as code from h_iban) h "
            f"join (values {table}) l(country, want) on l.country = substr(h.code, 1, 2))"
        )
    if wanted("PERSONAL_ID"):
        add("PERSONAL_ID", "h_pid", fv.PERSONAL_ID, 0.75)
    if wanted("SOCIAL_SECURITY"):
        add("SOCIAL_SECURITY", "h_svn", fv.SOCIAL_SECURITY, 0.9)
    if wanted("TAX_ID"):
        add(
            "TAX_ID", "h_tax", fv.TAX_ID, "case when (11 - p) % 11 = substr(d, 11, 1)::int then 1.0 else 0.6 end",
            where="p <> 1", frm="h_tax_checked",
        )
        ctes.append(
            f"h_tax_checked as (select *, list_reduce(list_concat([10], {numbers('substr(d, 1, 10)')}), "
            "lambda p, x: (case when (p + x) % 10 = 0 then 10 else (p + x) % 10 end) * 2 % 11) as p "
            "from (select *, replace(text, ' ', '') as d from h_tax))"
        )
    if wanted("VAT_ID"):
        add("VAT_ID", "h_vat", fv.VAT_ID, 0.85)
    if wanted("KVNR"):
        code = "lpad((ord(substr(text, 1, 1)) - 64)::varchar, 2, '0') || substr(text, 2, 8)"
        total = (
            f"list_sum(list_transform(range(1, 11), lambda j: (substr({code}, j, 1)::int * (2 - j % 2)) // 10 + "
            f"(substr({code}, j, 1)::int * (2 - j % 2)) % 10))"
        )
        add("KVNR", "h_kvnr", fv.KVNR, f"case when {total} % 10 = substr(text, 10, 1)::int then 0.95 else 0.6 end")
    if wanted("LICENSE_PLATE"):
        for name, pattern, confidence in (("h_plate1", fv.PLATE_HYPHEN, 0.75), ("h_plate2", fv.PLATE_SPACE, 0.65)):
            # the match by itself has no word character in front of an umlaut
            form = lit(pattern.replace(r"\b", ""))
            size = " + ".join(f"length(regexp_extract(text, {form}, {g}))" for g in (1, 2))
            size += f" + length(rtrim(regexp_extract(text, {form}, 3), 'EH'))"
            add("LICENSE_PLATE", name, pattern, confidence, where=f"{size} between 4 and 8")
    if wanted("DRIVER_LICENSE"):
        ctes.append(hits("h_context", source, fv.DRIVER_CONTEXT))
        reach = fv.DRIVER_CONTEXT_BYTES
        add(
            "DRIVER_LICENSE", "h_dl", fv.DRIVER_LICENSE, 0.75,
            where=f"exists (select 1 from h_context c where c.scan_id = h_dl.scan_id and c.start >= h_dl.start - {reach} "
            f"and c.start + strlen(c.text) <= h_dl.start + strlen(h_dl.text) + {reach})",
        )
    if wanted("ADDRESS"):
        add("ADDRESS", "h_address", fv.address_pattern(), 0.9, needs=r"regexp_matches(text, '\b\d{4,5}\b')")
    return ",\n".join(ctes), "\n  union all ".join(selects)


CORPUS = f"corpus as materialized (select doc_id as scan_id, {planted.CORPUS_TEXT} as text from documents)"
TURNS = (
    f"turns as materialized (select {planted.REQUEST_ID} as request_id, conv_id, turn, role, {planted.TURN_TEXT} as text "
    "from conversations)"
)
BODIES = f"{TURNS},\nbodies as materialized (select request_id, conv_id, {planted.BODY} as body from (select *, {', '.join(planted.BODY_PARTS)} from turns))"


def candidate_ctes(source: str = "corpus", types: list[str] | None = None) -> str:
    ctes, union = detectors(source, types or fv.PII_TYPES)
    return f'{ctes},\ncand as materialized (select *, start + strlen(text) as "end", strlen(text) as len from (\n  {union}))'


def scan_ctes(source: str = "corpus", types: list[str] | None = None, keep: str = "true") -> str:
    """From source(scan_id, text) to placed (findings) and masked (texts). ``keep`` filters the candidates c."""
    return f"""{candidate_ctes(source, types)},
ranked as materialized (
  select *, row_number() over (partition by scan_id order by start, prio desc, len desc, seq) as rn from cand c where {keep}),
fold as (
  select scan_id, rn, 1 as slot, rn as kept, "end" as last_end, prio, len from ranked where rn = 1
  union all
  select r.scan_id, r.rn, case when r.start >= f.last_end then f.slot + 1 else f.slot end,
    case when r.start >= f.last_end or r.prio > f.prio or (r.prio = f.prio and r.len > f.len) then r.rn else f.kept end,
    case when r.start >= f.last_end or r.prio > f.prio or (r.prio = f.prio and r.len > f.len) then r."end" else f.last_end end,
    case when r.start >= f.last_end or r.prio > f.prio or (r.prio = f.prio and r.len > f.len) then r.prio else f.prio end,
    case when r.start >= f.last_end or r.prio > f.prio or (r.prio = f.prio and r.len > f.len) then r.len else f.len end
  from fold f join ranked r on r.scan_id = f.scan_id and r.rn = f.rn + 1),
resolved as materialized (
  select r.*, w.slot from (select scan_id, slot, arg_max(kept, rn) as kept from fold group by scan_id, slot) w
  join ranked r on r.scan_id = w.scan_id and r.rn = w.kept),
named as (
  select scan_id, text, first_type, dense_rank() over (partition by scan_id, first_type order by first_start) as n from (
    select scan_id, text, min(start) as first_start, arg_min(pii_type, start) as first_type from resolved group by scan_id, text)),
placed as materialized (
  select r.*, '[' || n.first_type || '_' || n.n || ']' as placeholder
  from resolved r join named n on n.scan_id = r.scan_id and n.text = r.text),
gaps as (
  select p.scan_id, p.slot, p.placeholder, p.cstart + length(p.text) as cend,
    substr(s.text, coalesce(lag(p.cstart + length(p.text)) over (partition by p.scan_id order by p.slot), 0) + 1,
      p.cstart - coalesce(lag(p.cstart + length(p.text)) over (partition by p.scan_id order by p.slot), 0)) as gap
  from placed p join {source} s on s.scan_id = p.scan_id),
joined as (
  select scan_id, string_agg(gap || placeholder, '' order by slot) as head, max(cend) as cend, count(*) as n_findings
  from gaps group by scan_id),
masked as materialized (
  select s.scan_id, s.text, case when j.scan_id is null then s.text else j.head || substr(s.text, j.cend + 1) end as anonymised_text,
    coalesce(j.n_findings, 0)::bigint as n_findings
  from {source} s left join joined j on j.scan_id = s.scan_id)"""


def whitelist_keep(tokens: list[str]) -> str:
    cleaned = [t.strip().lower() for t in tokens]
    return " and ".join(f"not contains(lower(c.text), {lit(t)})" for t in cleaned if t)


#: Texts with the placeholders of number 2 left in every fifth one.
RESTORED = """
select m.scan_id, case when j.scan_id is null then m.text else j.head || substr(m.text, j.cend + 1) end as restored_text
from masked m left join (
  select g.scan_id, string_agg(g.gap || case when g.scan_id % 5 = 0 and g.placeholder like '%|_2]' escape '|' then g.placeholder else p.text end,
    '' order by g.slot) as head, max(g.cend) as cend
  from gaps g join placed p on p.scan_id = g.scan_id and p.slot = g.slot group by g.scan_id) j on j.scan_id = m.scan_id"""

FLAT = 'scan_id, pii_type, start, "end", text, confidence, rule_id'


def on_corpus(select: str, **options) -> str:
    """``select`` may begin with a comma and more CTEs."""
    return f"with recursive {CORPUS},\n{scan_ctes(**options)}\n{select}"


# segments of request bodies; scan_id is the request and the path
SEGMENTS = f"""{BODIES},
parsed as materialized (
  select request_id, body, case when body = '' then 'empty' when json_valid(body) and json_type(body) = 'OBJECT' then 'json' else 'text' end as kind
  from bodies),
messages as (
  select request_id, m, i - 1 as i from (
    select request_id, unnest(ms) as m, generate_subscripts(ms, 1) as i
    from (select request_id, json_extract(body, '$.messages[*]') as ms from parsed where kind = 'json'))
  where json_extract_string(m, '$.role') = 'user'),
contents as (select request_id, 'messages[' || i || '].content' as path, json_extract(m, '$.content') as c from messages),
blocks as (
  select request_id, path || '[' || (j - 1) || ']' as path, b from (
    select request_id, path, unnest(bs) as b, generate_subscripts(bs, 1) as j
    from (select request_id, path, json_extract(c, '$[*]') as bs from contents where json_type(c) = 'ARRAY'))),
parts as (
  select request_id, path || '.content[' || (k - 1) || '].text' as path, json_extract(p, '$.text') as v from (
    select request_id, path, unnest(ps) as p, generate_subscripts(ps, 1) as k
    from (select request_id, path, json_extract(b, '$.content[*]') as ps from blocks
          where json_extract_string(b, '$.type') = 'tool_result' and json_type(b, '$.content') = 'ARRAY'))),
inputs as (
  select request_id, path || '.input' as path, json_extract(b, '$.input') as v from blocks
  where json_extract_string(b, '$.type') = 'tool_use' and json_type(b, '$.input') = 'OBJECT'
  union all
  select request_id, path || '.' || key as path, json_extract(v, '$."' || key || '"') as v
  from (select request_id, path, v, unnest(json_keys(v)) as key from inputs where json_type(v) = 'OBJECT')),
leaves as (
  select request_id, path, c as v from contents
  union all select request_id, path || '.text', json_extract(b, '$.text') from blocks where json_extract_string(b, '$.type') = 'text'
  union all select request_id, path || '.content', json_extract(b, '$.content') from blocks where json_extract_string(b, '$.type') = 'tool_result'
  union all select request_id, path, v from parts
  union all select request_id, path, v from inputs),
segments as materialized (
  select request_id || ' ' || path as scan_id, request_id, path, json_extract_string(v, '$') as text from leaves where json_type(v) = 'VARCHAR'
  union all select request_id || ' body', request_id, 'body', body from parsed where kind = 'text')"""

SUMMARIES = """
found as (select s.request_id, p.* from placed p join segments s on s.scan_id = p.scan_id),
sizes as (
  select s.request_id, greatest(0, sum(strlen(s.text)) - sum(strlen(m.anonymised_text)))::bigint as masked_bytes
  from segments s join masked m on m.scan_id = s.scan_id group by s.request_id),
summaries as materialized (
  select q.request_id, q.kind, count(f.text) as pii_found,
    coalesce(case when q.kind = 'text' then string_agg(f.pii_type, ',' order by f.start) else array_to_string(list_sort(list_distinct(list(f.pii_type))), ',') end, '') as pii_types,
    coalesce(array_to_string(list_sort(list_distinct(list(f.placeholder))), ','), '') as placeholders,
    q.kind = 'json' as is_json, coalesce(any_value(z.masked_bytes), 0) as masked_bytes
  from parsed q left join found f on f.request_id = q.request_id left join sizes z on z.request_id = q.request_id
  group by q.request_id, q.kind)"""


def on_bodies(select: str, segments: str = SEGMENTS, keep: str = "true") -> str:
    return f"with recursive {segments},\n{scan_ctes('segments', keep=keep)},{SUMMARIES}\n{select}"


def segment_rows(pattern: str) -> str:
    return on_bodies(
        "select s.request_id, s.path, m.anonymised_text, m.n_findings from segments s join masked m on m.scan_id = s.scan_id "
        f"where regexp_matches(s.path, {lit(pattern)})"
    )


SUMMARY_ROW = "select request_id, pii_found, pii_types, placeholders, is_json, masked_bytes from summaries"


def dry_run() -> str:
    segments = f"""{BODIES},
parsed as materialized (select request_id, body, 'dry_run' as kind from bodies),
segments as materialized (select request_id || ' body' as scan_id, request_id, 'body' as path, body as text from parsed where body <> '')"""
    return on_bodies(SUMMARY_ROW.replace("masked_bytes from", "0::bigint as masked_bytes from"), segments)


def policy_apply() -> str:
    """Per-request lists: candidates are kept if the policy of the request names their type and no token is in them."""
    port = "8000 + (s.request_id // 1000) % 27"
    segments = SEGMENTS.replace(
        "select request_id, body, case when body = ''",
        "select request_id, body, case when body = '' then 'empty' when port < 8025 and (port - 8000) % 6 = 5 then 'dry_run' when body = ''",
    ).replace("from bodies),\nmessages", "from (select *, 8000 + conv_id % 27 as port from bodies)),\nmessages")
    segments = segments.replace("from parsed where kind = 'text')", "from parsed where kind in ('text', 'dry_run'))")
    key = f"(select any_value({port}) from segments s where s.scan_id = c.scan_id)"
    keep = f"""case when {key} >= 8025 then true when ({key} - 8000) % 5 = 0 then true when ({key} - 8000) % 5 = 1 then c.pii_type = 'EMAIL'
      when ({key} - 8000) % 5 = 2 then c.pii_type in ('IBAN', 'SECRET') when ({key} - 8000) % 5 = 3 then c.pii_type in ('PHONE', 'URL_SECRET', 'ADDRESS')
      else c.pii_type in ('EMAIL', 'KVNR') end
    and not ({key} < 8025 and ({key} - 8000) % 2 = 0 and (contains(lower(c.text), 'firma1') or contains(lower(c.text), 'zürich')))"""
    select = SUMMARY_ROW.replace(
        "masked_bytes from", "case when kind = 'dry_run' then 0 else masked_bytes end::bigint as masked_bytes from"
    )
    return on_bodies(select, segments, keep)


#: Paths of the texts that are masked, by layout of the body.
_BLOCK = "messages[1].content[0]"
MASKED_PATHS = [
    ["messages[1].content"],
    [f"{_BLOCK}.text"],
    [f"{_BLOCK}.content"],
    [f"{_BLOCK}.content[0].text", f"{_BLOCK}.content[1].text"],
    [f"{_BLOCK}.input.a", f"{_BLOCK}.input.b.c", f"{_BLOCK}.input.b.e.f.g"],
    [], [], [],
    ["messages[1].content"],
    [],
    ["messages[0].content"],
]


def whole_bodies(value: str) -> str:
    """Bodies put together again, with ``value`` (SQL over a row m of segments) where a text is masked."""

    def told(path: str) -> str:
        return planted._quoted(f"(select {value} from told m where m.scan_id = b.request_id || ' {path}')")

    parts = planted.layouts([[told(p) for p in paths] for paths in MASKED_PATHS], "said", "extra", "more")
    # of a repeated key the last value is left, and the object is written anew
    parts[10] = f"concat('{{\"messages\":[{{\"content\":', {told('messages[0].content')}, ',\"role\":\"user\"}}],\"model\":\"b\"}}')"
    raw = f"(select {value} from told m where m.scan_id = b.request_id || ' body')"
    return (
        f"case when kind = 'text' then {raw} when kind = 'empty' then '' when role = 'user' or request_id % 11 = 10 "
        f"then {planted.by_layout(parts)} else body end"
    )


WHOLE = (
    f"whole as (select p.request_id, p.kind, p.body, t.role, t.text, {', '.join(planted.BODY_PARTS).replace('(request_id', '(p.request_id')} "
    "from parsed p join turns t on t.request_id = p.request_id)"
)
MASKED_WHOLE = f"select request_id, kind, {whole_bodies('m.anonymised_text')} as masked_body from whole b"
RESTORED_WHOLE = f"select request_id, {whole_bodies('m.restored')} as restored_body from whole b"


def policy_as_of() -> str:
    """The version by a plain join with all earlier ones; then per-request lists as in policy_apply."""
    versions = """versions as (
  select n_nationkey as n, v, 8000 + n_nationkey as port, 1704067200 + least(v, 2) * 86400 + n_nationkey * 3600 as since
  from nation, range(0, 4) r(v) where v < 3 or n_nationkey % 4 = 0),
asked as (select request_id, case when conv_id % 2 = 0 then 8008 else 8000 + conv_id % 27 end as port, 1704067200 + request_id * 7919 % 300000 as moment from bodies),
chosen as materialized (
  select a.request_id, max(struct_pack(since := since, v := v, n := n)) as c from asked a join versions on versions.port = a.port and since <= moment group by a.request_id),
ruled as materialized (
  select b.request_id, c.v::int as version, case when not (c.n = 9 and c.v = 1) then c.n + c.v end as k from bodies b left join chosen h on h.request_id = b.request_id)"""
    segments = SEGMENTS.replace(
        "parsed as materialized", f"{versions},\nparsed as materialized", 1
    ).replace(
        "select request_id, body, case when body = ''",
        "select request_id, body, case when body = '' then 'empty' when k % 6 = 5 then 'dry_run' when body = ''",
    ).replace("from bodies),\nmessages", "from bodies join ruled using (request_id)),\nmessages")
    segments = segments.replace("from parsed where kind = 'text')", "from parsed where kind in ('text', 'dry_run'))")
    k = "(select any_value(r.k) from segments s join ruled r on r.request_id = s.request_id where s.scan_id = c.scan_id)"
    keep = f"""case when {k} is null or {k} % 5 = 0 then true when {k} % 5 = 1 then c.pii_type = 'EMAIL'
      when {k} % 5 = 2 then c.pii_type in ('IBAN', 'SECRET') when {k} % 5 = 3 then c.pii_type in ('PHONE', 'URL_SECRET', 'ADDRESS')
      else c.pii_type in ('EMAIL', 'KVNR') end
    and not (coalesce({k} % 2 = 0, false) and (contains(lower(c.text), 'firma1') or contains(lower(c.text), 'zürich')))"""
    select = SUMMARY_ROW.replace(
        "masked_bytes from summaries",
        "case when kind = 'dry_run' then 0 else masked_bytes end::bigint as masked_bytes, version from summaries join ruled using (request_id)",
    )
    return on_bodies(select, segments, keep)


TOKEN_TABLE = TOKENS.replace("{orders}", "orders")
WHITELIST_TABLE_KEEP = f"""not exists (select 1 from (select distinct lower(trim(token)) as tok from ({TOKEN_TABLE})) t
  where t.tok <> '' and contains(lower(c.text), t.tok))"""
NUMBERED = """numbered as (
  select pii_type, text, '[' || pii_type || '_' || row_number() over (partition by pii_type order by doc, start, text) || ']' as pseudonym, docs
  from (select pii_type, text, min(scan_id) as doc, arg_min(start, (scan_id, start)) as start, count(distinct scan_id) as docs
        from placed group by pii_type, text))"""


FALLBACK_KEEP = """case when c.scan_id % 3 = 0 then c.pii_type in ('EMAIL', 'SECRET')
    when c.scan_id % 5 < 3 then c.pii_type in ('PHONE', 'IBAN', 'EMAIL') else true end
  and not contains(lower(c.text), 'firma2') and not contains(lower(c.text), 'firma4')"""

SELECTION_KEEP = """case when c.scan_id % 4 = 0 then true when c.scan_id % 4 = 1 then c.pii_type in ('IBAN', 'PHONE')
  when c.scan_id % 4 = 2 then c.pii_type = 'ADDRESS' else false end"""

ENTRY_TABLE = ENTRIES.replace("{events}", "events").replace("array(", "list_value(").replace("array<string>", "varchar[]")
LOG_TEXT = (
    "printf('%s  %-6s %-30s  %d  %5d B  %s', strftime(ts, '%Y-%m-%d %H:%M:%S'), method, path, status, resp_bytes, "
    "'pii=' || pii_count || case when len(pii_types) > 0 then ' [' || array_to_string(pii_types, ',') || ']' else '' end)"
)
LINES = f"""entries as (select seq, ts::timestamp as ts, source, method, path, status, resp_bytes, pii_count, pii_types from ({ENTRY_TABLE})),
lines as (select seq, source, case when seq % 97 = 0 then '  broken ' || substr(l, 12, 60) else l end as line, seq % 97 = 0 as broken
  from (select *, {LOG_TEXT} as l from entries))"""
CALL_TABLE = CALLS.replace("{events}", "events")
PRESENTED = """nullif(case when coalesce(api_key, '') <> '' then api_key when auth like 'Bearer %' then substr(auth, 8) end, '')"""
BURST_TABLE = f"""select event_id as seq, case when event_id % 2 = 0 then 'k:busy' else 'ip:' || user_id % 10 end as rate_key,
  1704067200000000 + (epoch_us(ts::timestamp) - 1704067200000000) // 2000 as us from events"""
ADMITTED = f"""select seq, rate_key, row_number() over (partition by rate_key, us // 60000000 order by us, seq) <= {fv.CALLS_PER_MINUTE} as admitted
from ({BURST_TABLE})"""
EXPOSITION = """
  select '# TYPE pii_scan_requests_total counter' as line union all select 'pii_scan_requests_total ' || count(*) from summaries
  union all select '# TYPE pii_scan_pii_findings_total counter' union all select 'pii_scan_pii_findings_total ' || sum(pii_found)::bigint from summaries
  union all select '# TYPE pii_scan_masked_bytes_total counter' union all select 'pii_scan_masked_bytes_total ' || sum(masked_bytes)::bigint from summaries
  union all select 'pii_scan_pii_type_total{type="' || pii_type || '"} ' || count(*) from type_entries group by pii_type"""
TYPE_ENTRIES = "type_entries as (select unnest(string_split(pii_types, ',')) as pii_type from summaries where pii_types <> '')"


def src_policies() -> str:
    def strings(path: str, frm: str) -> str:
        return f"coalesce(array_to_string(json_extract_string({frm}, '{path}[*]'), ','), '')"

    kind = "coalesce(case when json_valid(json) then json_type(json, '$.api_port') end, 'NULL')"
    return f"""with docs as (select c_custkey as doc_no, {POLICY_JSON} as json from customer),
checked as (select *, json is null or (json_valid(json) and {kind} in ('UBIGINT', 'BIGINT', 'NULL')) as valid,
  case when json_valid(json) and {kind} in ('UBIGINT', 'BIGINT', 'NULL') then json::json end as root from docs),
listed as (select *, case when json_type(root) = 'ARRAY' then json_extract(root, '$[*]') else json_extract(root, '$.proxies[*]') end as ps from checked),
policies as (
  select *, unnest(ps) as p, generate_subscripts(ps, 1) - 1 as policy_no from listed where len(ps) > 0
  union all select *, null as p, 0 as policy_no from listed where coalesce(len(ps), 0) = 0)
select doc_no, valid, policy_no::int as policy_no, json_extract(root, '$.api_port')::int as api_port, json_extract_string(p, '$.type') as policy_type,
  coalesce(json_extract(p, '$.port')::int, case when valid then {fv.DEFAULT_POLICY_PORT} end) as port, json_extract_string(p, '$.upstream') as upstream,
  coalesce(json_extract(p, '$.guard.dry_run')::boolean, false) as dry_run,
  {strings("$.default_detectors", "root")} as default_detectors, {strings("$.default_whitelist", "root")} as default_whitelist,
  {strings("$.guard.detectors", "p")} as detectors, {strings("$.guard.whitelist", "p")} as whitelist
from policies"""


def merge_whitelists() -> str:
    return """with tokens as (
  select c_custkey as row_no, unnest(l) as tok, generate_subscripts(l, 1) as pos from (
    select c_custkey, list_value(' Alpha ', '', concat('K', c_custkey % 4), 'beta', lower(c_mktsegment), concat('k', c_custkey % 5),
      'ALPHA', chr(9), 'Gamma', 'gamma') as l from customer)),
cleaned as (select row_no, trim(tok, ' ' || chr(9)) as tok, pos from tokens),
firsts as (select row_no, tok, pos, row_number() over (partition by row_no, lower(tok) order by pos) as n from cleaned where tok <> '')
select row_no, string_agg(tok, '|' order by pos) as tokens, count(*)::int as n_tokens from firsts where n = 1 group by row_no"""


def queries() -> dict[str, str]:
    out: dict[str, str] = {}
    out["src_corpus"] = """select doc_id as scan_id, 0 as seg_id, null::varchar as role, 'text' as path, text from documents
union all select page_id, 0, null, 'html', html from pages union all select item_id, 0, null, 'text', text from benchmark
union all select conv_id, turn::int, role, 'text', text from conversations"""
    kinds = "case when body = '' then 'empty' when json_valid(body) and json_type(body) = 'OBJECT' then 'json' else 'text' end as kind"
    out["src_requests"] = (
        f"with {BODIES} select request_id, case when request_id % 7 = 0 then 'text' else {kinds.removesuffix(' as kind')} end as kind, "
        "request_id % 7 = 0 as quarantined, (strlen(body) + case when request_id % 7 = 0 then 2 else 0 end)::bigint as n_bytes from bodies"
    )
    out["body_triage"] = f"with {BODIES} select request_id, {kinds} from bodies"
    out["src_access_log"] = f"""with {LINES} select l.seq, case when not broken then date_trunc('second', ts) end as ts,
  case when not broken then method end as method, case when not broken then path end as path, case when not broken then status end as status,
  case when not broken then resp_bytes end as resp_bytes, case when not broken then pii_count end as pii_count,
  case when not broken then array_to_string(pii_types, ',') end as pii_types from lines l join entries e on e.seq = l.seq"""
    out["src_policies"] = src_policies()
    for t in fv.PII_TYPES:
        out[f"det_{t.lower()}"] = f"with {CORPUS},\n{candidate_ctes(types=[t])}\nselect {FLAT} from cand"
    out["select_detectors"] = on_corpus(f"select {FLAT}, placeholder from placed", keep=SELECTION_KEEP)
    out["candidates_all"] = f"with {CORPUS},\n{candidate_ctes()}\nselect {FLAT}, prio::int as prio, ordinal::int as ordinal from cand"
    out["whitelist_filter"] = on_corpus(f"select {FLAT}, placeholder from placed", keep=whitelist_keep(WHITELIST))
    out["merge_whitelists"] = merge_whitelists()
    out["resolve_overlaps"] = on_corpus(f"select {FLAT} from placed")
    out["assign_placeholders"] = on_corpus("select scan_id, start, text, placeholder from placed")
    out["redact"] = on_corpus("select scan_id, anonymised_text from masked")
    out["scan_full"] = on_corpus(
        "select m.scan_id, m.anonymised_text, m.n_findings, coalesce(f.findings, '') as findings from masked m left join (select scan_id, "
        "string_agg(pii_type || ':' || start || ':' || \"end\" || ':' || placeholder, ' ' order by start) as findings from placed "
        "group by scan_id) f on f.scan_id = m.scan_id"
    )
    out["anonymize"] = out["redact"]
    out["placeholder_map"] = on_corpus("select distinct scan_id, placeholder, text from placed")
    # restoring gives the input back, but for entries that are missing
    out["restore"] = on_corpus(RESTORED)
    out["findings_report"] = on_corpus(
        "select scan_id, row_number() over (partition by scan_id order by start)::int as row_no, pii_type, text, placeholder, "
        "printf('%.0f%%', confidence * 100) as confidence from placed"
    )
    out["quarantine_invalid_utf8"] = (
        f"with {BODIES} select request_id, request_id % 7 = 0 as quarantined, case when request_id % 7 = 0 then '{fv.BINARY_PLACEHOLDER}' "
        "else body end as body, case when request_id % 7 = 0 then hex(body) || 'C328' end as raw_hex from bodies"
    )
    user_turns = f"{TURNS},\nsegments as materialized (select request_id as scan_id, text from turns where role = 'user')"
    out["mask_user_messages"] = (
        f"with recursive {user_turns},\n{scan_ctes('segments')}\nselect t.conv_id, t.turn, t.role, coalesce(m.anonymised_text, t.text) as "
        "anonymised_text, coalesce(m.n_findings, 0)::bigint as n_findings from turns t left join masked m on m.scan_id = t.request_id"
    )
    out["mask_text_blocks"] = segment_rows(r"\.content\[[0-9]+\]\.text$")
    out["mask_tool_results"] = segment_rows(r"\]\.content\[[0-9]+\]\.content")
    out["mask_tool_inputs"] = segment_rows(r"\.input\.")
    out["mask_raw_body"] = segment_rows("^body$")
    told = "told as materialized (select scan_id, anonymised_text from masked)"
    out["masked_body"] = on_bodies(f",\n{told},\n{WHOLE}\n{MASKED_WHOLE}")
    out["request_findings"] = on_bodies('select request_id, s.path, f.pii_type, f.start, f."end", f.text, f.placeholder from placed f join segments s using (scan_id)')
    out["body_vault"] = on_bodies("select distinct request_id, s.path, f.placeholder, f.text from placed f join segments s using (scan_id)")
    back = f"told as materialized (select r.scan_id, r.restored_text as restored from ({RESTORED.replace('g.scan_id % 5', 'q.request_id % 5').replace('group by g.scan_id', 'join segments q on q.scan_id = g.scan_id group by g.scan_id')}) r)"
    out["restore_bodies"] = on_bodies(f",\n{back},\n{WHOLE}\n{RESTORED_WHOLE}")
    out["policy_as_of"] = policy_as_of()
    out["whitelist_table"] = on_corpus("select scan_id, anonymised_text, n_findings from masked", keep=WHITELIST_TABLE_KEEP)
    out["corpus_numbered_pseudonyms"] = on_corpus(f",\n{NUMBERED}\nselect * from numbered")
    out["corpus_masked_by_pseudonyms"] = on_corpus(
        f""",\n{NUMBERED}
select m.scan_id, case when j.scan_id is null then m.text else j.head || substr(m.text, j.cend + 1) end as masked_text
from masked m left join (
  select g.scan_id, string_agg(g.gap || n.pseudonym, '' order by g.slot) as head, max(g.cend) as cend
  from gaps g join placed p on p.scan_id = g.scan_id and p.slot = g.slot join numbered n on n.pii_type = p.pii_type and n.text = p.text
  group by g.scan_id) j on j.scan_id = m.scan_id"""
    )
    out["dry_run_report"] = dry_run()
    out["scan_summary"] = on_bodies(SUMMARY_ROW.replace(", masked_bytes", ""))
    out["masked_bytes"] = on_bodies("select request_id, masked_bytes from summaries")
    out["policy_apply"] = policy_apply()
    out["default_policy_fallback"] = on_corpus(
        "select scan_id, case when scan_id % 3 = 0 then 'EMAIL,SECRET' when scan_id % 5 < 3 then 'PHONE,iban,EMAIL' else '' end as detectors, "
        "case when scan_id % 2 = 0 then 'FIRMA2,firma4' else 'FIRMA2,firma4' end as whitelist, n_findings, anonymised_text from masked",
        keep=FALLBACK_KEEP,
    )
    out["metrics_totals"] = on_bodies(
        "select count(*) as requests, sum(pii_found)::bigint as findings, sum(masked_bytes)::bigint as masked_bytes from summaries"
    )
    out["metrics_by_type"] = on_bodies("select pii_type, count(*) as n from type_entries group by pii_type").replace(
        "\nselect pii_type, count(*)", f",\n{TYPE_ENTRIES}\nselect pii_type, count(*)"
    )
    out["log_status_class"] = f"""with {LINES}, tokens as (
  select seq, unnest(t) as tok, generate_subscripts(t, 1) as i from (select seq, string_split_regex(trim(line), '\\s+') as t from lines)),
firsts as (select seq, arg_min(tok::int, i) as code from tokens where i > 2 and regexp_matches(tok, '^[2-5][0-9][0-9]$') group by seq)
select l.seq, case when code >= 500 then 'danger' when code >= 400 then 'warning' when code >= 200 then 'success' else 'neutral' end as status_class
from lines l left join firsts f on f.seq = l.seq"""
    out["log_pii_flag"] = f"with {LINES} select seq, regexp_matches(line, '^[^=]*pii=[^0]') as has_pii from lines"
    out["log_tail"] = f"""with {LINES} select source, seq, from_end::int as from_end from (
  select source, seq, row_number() over (partition by source order by ts desc, seq desc) as from_end from entries) where from_end <= {fv.LOG_TAIL_LINES}"""
    out["log_traffic_report"] = f"""with {LINES} select source, path, status, grouping(source, path, status)::int as level, count(*) as requests,
  count(*) filter (where status >= 400) as errors, sum(resp_bytes)::bigint as resp_bytes, sum(pii_count)::bigint as pii_findings
from entries group by rollup(source, path, status)"""
    out["rate_key"] = f"""select seq, coalesce('k:' || sha256({PRESENTED}), 'ip:' || case
  when regexp_matches(addr, '^\\[[^\\[\\]]*\\]:[^:]*$') then regexp_extract(addr, '^\\[(.*)\\]:', 1)
  when regexp_matches(addr, '^[^:\\[\\]]*:[^:\\[\\]]*$') then string_split(addr, ':')[1] else addr end) as rate_key from ({CALL_TABLE})"""
    out["rate_admit"] = ADMITTED
    out["stream_rate"] = ADMITTED
    out["api_key_admit"] = f"""select seq, coalesce(sha256({PRESENTED}) in (
  select sha256(concat('key-', n_nationkey)) from nation where n_nationkey % 3 <> 0), false) as admitted from ({CALL_TABLE})"""
    out["sink_findings"] = on_corpus('select scan_id, pii_type, start, "end", text, placeholder from placed')
    out["sink_redacted"] = on_corpus("select scan_id, anonymised_text, n_findings from masked")
    out["sink_mapping"] = out["placeholder_map"]
    out["sink_repeated"] = on_corpus("select 'part-' || (scan_id % 3) as batch, scan_id, anonymised_text, n_findings from masked")
    out["findings_flat"] = on_corpus(f"select {FLAT}, placeholder from placed")
    out["sink_access_log"] = f"with {LINES} select {LOG_TEXT} as line from entries"
    out["sink_metrics"] = on_bodies(EXPOSITION).replace(EXPOSITION, f",\n{TYPE_ENTRIES}\nselect line from ({EXPOSITION})")
    out["stream_scan"] = out["sink_redacted"]
    out["stream_sink"] = on_corpus(
        "select m.scan_id, m.anonymised_text, m.n_findings as pii_found, coalesce(f.pii_types, '') as pii_types, coalesce(f.placeholders, '') as "
        "placeholders, f.last_end, f.n_findings, f.n_entries, f.vault_bytes from masked m left join (select scan_id, "
        "array_to_string(list_sort(list_distinct(list(pii_type))), ',') as pii_types, array_to_string(list_sort(list_distinct(list(placeholder))), ',') "
        'as placeholders, max("end") as last_end, count(*) as n_findings, count(distinct text) as n_entries, '
        "(select sum(strlen(t))::bigint from (select distinct text as t from placed q where q.scan_id = p.scan_id)) as vault_bytes "
        "from placed p group by scan_id) f on f.scan_id = m.scan_id"
    )
    event_texts = f"corpus as materialized (select event_id as scan_id, ts, {planted.sentence('event_id')} as text from events)"
    out["stream_metrics"] = f"""with recursive {event_texts},\n{scan_ctes()}
select date_trunc('minute', e.ts) as minute, p.pii_type, count(*) as n from placed p join corpus e on e.scan_id = p.scan_id group by 1, 2"""
    out["stream_windows"] = f"""with recursive {event_texts},\n{scan_ctes()},
waves as (select event_id, ts, {WAVE} as wave from events),
lasts as (select wave, max(ts) as last from waves group by wave),
marks as (select wave, max(last) over (order by wave rows between unbounded preceding and 1 preceding) - interval 10 minutes as mark from lasts),
told as (select date_trunc('minute', w.ts) as minute, p.pii_type, coalesce(date_trunc('minute', w.ts) + interval 1 minute <= m.mark, false) as is_late
  from placed p join waves w on w.event_id = p.scan_id join marks m on m.wave = w.wave)
select minute, pii_type, count(*) filter (where not is_late) as n, count(*) filter (where is_late) as late,
  minute + interval 1 minute <= (select max(ts) from events) - interval 10 minutes as closed from told group by minute, pii_type"""
    out["corpus_pii_profile"] = on_corpus(
        "select d.lang, p.pii_type, grouping(d.lang, p.pii_type)::int as level, count(*) as findings, count(distinct p.scan_id) as docs "
        "from placed p join documents d on d.doc_id = p.scan_id group by cube(d.lang, p.pii_type)"
    )
    out["corpus_pseudonyms"] = on_corpus(
        "select pii_type, text, '[' || pii_type || '_' || substr(sha256(pii_type || ':' || text), 1, 16) || ']' as pseudonym, "
        "count(distinct scan_id) as docs from placed group by pii_type, text"
    )
    out["corpus_shared_values"] = on_corpus(
        "select pii_type, text, count(distinct scan_id) as docs from placed group by pii_type, text having count(distinct scan_id) > 1"
    )
    out["corpus_shared_sketches"] = on_corpus(
        "select pii_type, text, count(distinct scan_id) as docs, count(distinct day) as days from (select pii_type, text, scan_id, "
        "unnest(case when scan_id % 3 = 0 then [scan_id % 5, scan_id % 5 + 1] else [scan_id % 5] end) as day from placed) "
        "where day between 1 and 4 group by pii_type, text having count(distinct scan_id) > 1"
    )
    out["corpus_top_docs"] = on_corpus(
        f"select scan_id, count(*) as n_findings from placed group by scan_id order by n_findings desc, scan_id limit {TOP_DOCUMENTS}"
    )
    out["corpus_clean_split"] = on_corpus(
        "select m.scan_id, m.n_findings = 0 as clean, l.quality, l.toxic from masked m left join labels l on l.doc_id = m.scan_id"
    )
    pages = f"""corpus as materialized (
  select page_id || ' url' as scan_id, page_id, 'url' as part, concat(url, '?token=', substr(md5(url), 1, 12)) as text from pages
  union all select page_id || ' html', page_id, 'html', concat(html, ' ', {planted.sentence('page_id')}) from pages)"""
    out["scan_pages"] = f"""with recursive {pages},\n{scan_ctes()}
select c.page_id, c.part, m.anonymised_text, m.n_findings from masked m join corpus c on c.scan_id = m.scan_id"""
    return out
