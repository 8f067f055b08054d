"""The registered queries again, as SQL for DuckDB over the same tables.

Written apart from the Spark side: other formulations where possible, no shared code.
RE2 has no look-around and no back-references, so sentence and doubled-word rules are
put differently here.
"""

from __future__ import annotations

import re

# --- expressions -----------------------------------------------------------------------


def squash(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sents(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({strip(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def bare(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


def count_of(text: str, phrase: str) -> str:
    return f"cast((length({text}) - length(replace({text}, {phrase}, ''))) / length({phrase}) as integer)"


def words_in(x: str, stop: str, pattern: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{pattern}'), lambda w: not list_contains([{stop}], w))"


def cap(x: str) -> str:
    return f"upper({x}[1]) || lower({x}[2:])"


def first(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def quoted(x: str) -> str:
    straight = f"translate({x}, '“”‘’', '\"\"''''')"
    spans = f"""list_concat(regexp_extract_all({straight}, '"([^"]{{3,120}})"', 1), regexp_extract_all({straight}, '''([^'']{{3,120}})''', 1))"""
    return spans


REWRITE_STOP = "'the','a','an','and','or','to','of','in','on','for','with','by','from','as','is','are','was','were','be','that','this'"
OVERLAP_STOP = (
    "'the','and','for','with','from','that','this','was','were','are','is','to','of','in','on','by','or','a','an','as',"
    "'avoid','using','phrase','phrasing','consider','rephrasing','obvious','redundant','information','stating','remove','review'"
)


def rewrite_words(x: str) -> str:
    return words_in(x, REWRITE_STOP, "[a-z0-9'']+")


def overlap_words(x: str) -> str:
    return f"list_distinct({words_in(x, OVERLAP_STOP, '[a-z0-9]{3,}')})"


def high_signal(old: str, new: str) -> str:
    a, b = rewrite_words(old), rewrite_words(new)
    both = f"len(list_intersect({a}, {b}))"
    return (
        f"(not contains({old}, chr(10)) and not contains({new}, chr(10)) and len({a}) >= 2 and len({b}) >= 2 and {both} > 0"
        f" and not (len({a}) >= 6 and len({b}) >= 6 and {both} < 2))"
    )


def has_url_or_ip(x: str) -> str:
    return (
        rf"(regexp_matches({x}, '(?i)(https?://|www\.)\S+') or regexp_matches({x}, '\b([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}\b')"
        rf" or regexp_matches({x}, '\b([0-9A-Fa-f]{{1,4}}:){{2,}}[0-9A-Fa-f:]{{1,4}}\b'))"
    )


def score(x: str) -> str:
    low = f"lower({x})"
    number = "[0-9](?:\\.[0-9])?"
    return (
        rf"coalesce(try_cast({first(low, rf'({number})\s*cvss\s*:')} as double),"
        rf" try_cast({first(low, rf'cvss\s*(?:v{number})?\s*[:=]\s*({number})')} as double),"
        rf" list_filter(list_transform(regexp_extract_all({low}, '\b({number})\b', 1), lambda d: cast(d as double)), lambda d: d <> 4.0::double)[1])"
    )


def band(x: str) -> str:
    return f"case when {x} >= 9 then 'Critical' when {x} >= 7 then 'High' when {x} >= 4 then 'Medium' when {x} > 0 then 'Low' when {x} is not null then 'None' end"


def threat(x: str) -> str:
    names = "critical|high|medium|low|informational"
    found = rf"coalesce({first(x, rf'(?i)\bthreat\s*level\s*[:=]?\s*({names})\b')}, {first(x, rf'(?i)\b({names})\b')})"
    return cap(found)


def decision(x: str) -> str:
    tests = [
        ("reject", r"(?i)\[\s*reject(ed)?\s*\]"), ("accept", r"(?i)\[\s*accept(ed)?\s*\]"),
        ("reject", r"(?i)\breject(ed)?\s*[:\-]"), ("accept", r"(?i)\baccept(ed)?\s*[:\-]"),
        ("reject", r"(?i)^\s*reject(ed)?\s*$"), ("accept", r"(?i)^\s*accept(ed)?\s*$"),
    ]
    return "case " + " ".join(f"when regexp_matches({x}, '{p}') then '{d}'" for d, p in tests) + " end"


def hint_key(x: str) -> str:
    bare_text = rf"regexp_replace(regexp_replace(lower({strip(x)}), '\bsections?\b', '', 'g'), '\bthroughout the document\b', '', 'g')"
    return rf"trim(trim(regexp_replace({bare_text}, '\s+', ' ', 'g')), ' .,:;')"


def hints(x: str) -> str:
    parts = f"[{strip(x)}]"
    for splitter in (r"(?i)\s+and\s+", r"\s*/\s*", r"\s*,\s*"):
        parts = f"flatten(list_transform({parts}, lambda p: regexp_split_to_array(p, '{splitter}')))"
    keys = f"list_filter(list_transform({parts}, lambda p: {hint_key('p')}), lambda p: p <> '')"
    return f"list_filter({keys}, lambda p, i: list_position({keys}, p) = i)"


# --- derived tables ----------------------------------------------------------------------

VIEWS = {
    "v_paras": """
        select doc_id, cast(para_no as bigint) as para_no, trim(t) as text from (
          select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as para_no from documents)
        where trim(t) <> ''""",
    "v_texts": "select doc_id, string_agg(text, chr(10) order by para_no) as text from v_paras group by doc_id",
    "v_blocks": """
        select doc_id, para_no as block_no, 'p' as type,
          case when doc_id % 10 = 3 and para_no = 1 then 'List of Figures' else text end as text,
          case when para_no % 6 = 0 then 'heading ' || cast(1 + (para_no // 6) % 3 as varchar) else 'Normal' end as style_name,
          case when para_no % 6 = 0 then 1 + (para_no // 6) % 3 end as level
        from v_paras""",
    "v_breaks": """
        select doc_id, para_no, (doc_id + para_no) % 5 in (0, 1) as has_break,
          case when (doc_id + para_no) % 3 = 0 then '' else text end as text from v_paras""",
    "v_findings": """
        select o_custkey as doc_id, o_orderkey as finding_no, 'Finding ' || o_orderkey as title,
          case o_orderpriority[1] when '1' then 'Critical' when '2' then 'High' when '3' then 'Medium' when '5' then 'Low' else 'Informational' end as threat_text,
          case o_orderkey % 3 when 0 then s || ' CVSS:4.0/AV:N' when 1 then 'CVSS: ' || s else 'score ' || s end as cvss_text
        from (select *, ((o_orderkey % 100) // 10) || '.' || (o_orderkey % 10) as s from orders)""",
    "v_finding_lines": """
        select f.doc_id, f.finding_no, p.para_no as line_no,
          case when p.para_no % 4 = 0 then
            case (f.finding_no + p.para_no // 4) % 7 when 0 then 'Narrative:' when 1 then 'Business Impact:' when 2 then 'Recommendation:'
              when 3 then 'Evidence:' when 4 then 'Steps to Reproduce:' when 5 then 'Notes:' else 'Description: ' end
          when p.para_no % 9 = 5 then 'Figure ' || p.para_no || ' ' || p.text else p.text end as line
        from v_findings f join v_paras p on p.doc_id = f.finding_no % (select count(*) from documents)""",
    # The last label at or before each line decides the field.
    "v_labels": r"""
        select *, lower(trim(regexp_extract(line, '^([A-Za-z\s]+):\s*$', 1))) as label from v_finding_lines""",
    "v_current": """
        select *, count(*) filter (label <> '') over (partition by finding_no order by line_no) as stretch from v_labels""",
    # A stretch has one label, its first line.
    "v_fields": """
        select * from (
          select doc_id, finding_no,
            case head when 'narrative' then 'narrative' when 'vulnerability' then 'narrative' when 'description' then 'narrative'
              when 'business impact' then 'business_impact' when 'business imapct' then 'business_impact' when 'impact' then 'business_impact'
              when 'recommendations' then 'recommendations' when 'recommendation' then 'recommendations' when 'remediation' then 'recommendations'
              when 'evidence' then 'evidence' when 'proof' then 'evidence' when 'observation' then 'evidence' when 'poc' then 'evidence' when 'proof of concept' then 'evidence'
              when 'steps to reproduce' then 'reproduction' when 'reproduction steps' then 'reproduction' when 'reproduction' then 'reproduction' when 'reproduce' then 'reproduction' end as field,
            line_no, line
          from (select *, max(label) over (partition by finding_no, stretch) as head from v_current) where label = '' and line <> '')
        where field is not null""",
    "v_finding_facts": r"""
        select f.*, coalesce(t.chars, 0) as chars, coalesce(t.implicit, false) as implicit, coalesce(d.fields, []) as fields, d.narrative
        from v_findings f
        left join (select finding_no, length(string_agg(line, chr(10))) as chars,
                     bool_or(regexp_matches(lower(line), '^figure\b|^fig\.\b|\bscreenshot\b|\bproof of concept\b|\bpoc\b|\bpacket capture\b|\bburp\b')) as implicit
                   from v_finding_lines group by finding_no) t on t.finding_no = f.finding_no
        left join (select finding_no, list(distinct field) as fields,
                     string_agg(line, ' ' order by line_no) filter (field = 'narrative') as narrative from v_fields group by finding_no) d on d.finding_no = f.finding_no""",
    "v_sections_raw": """
        select *, count(level) over (partition by doc_id order by block_no) as section_no from v_blocks""",
    "v_sections": """
        select doc_id, section_no, level, text as title from v_sections_raw where level is not null
        union all select distinct doc_id, section_no, 0, 'Preamble' from v_sections_raw where section_no = 0""",
    # Parent: the nearest earlier section of a smaller level.
    "v_tree": """
        select a.doc_id, a.section_no, a.level, a.title, max(b.section_no) as parent_no
        from v_sections a left join v_sections b on b.doc_id = a.doc_id and b.section_no < a.section_no and b.level < a.level
        group by all""",
    "v_depth": """
        select doc_id, section_no, parent_no, 0 as depth from v_tree where parent_no is null
        union all select t.doc_id, t.section_no, t.parent_no, d.depth + 1 from v_tree t join v_depth d on d.doc_id = t.doc_id and d.section_no = t.parent_no""",
    "v_versions": """
        select doc_id, family, version, 'Report ' || family || '_v0.' || version || '.docx' as file_name
        from (select doc_id, min(doc_id) over (partition by lower(substr(text, 1, 60))) as family,
                row_number() over (partition by lower(substr(text, 1, 60)) order by doc_id) as version from documents)""",
    "v_versions_case": """
        select v.doc_id, v.family, v.version, p.para_no, case when v.version % 2 = 1 and p.para_no % 7 = 0 then lower(p.text) else p.text end as text
        from v_versions v join v_paras p on p.doc_id = v.doc_id""",
    "v_pairs": """
        select a.file_name || '::' || b.file_name as pair_id, 'report' || a.family as family, a.doc_id as old_doc, b.doc_id as new_doc, a.family as family_no, b.version as new_version
        from v_versions a join v_versions b on a.family = b.family and b.version = a.version + 1""",
    "v_layout": """
        select l_suppkey as doc_id, case when l_partkey % 10 < 8 then 'S' || (l_partkey % 4) else p_brand end as style_id,
          case when l_linenumber % 2 = 0 then 'both' else 'default' end as alignment,
          case when l_linenumber <= 5 then l_linenumber % 2 + 2 else l_linenumber end as columns,
          cast(floor(l_extendedprice) as bigint) as width_emu, cast(floor(l_quantity * 1000) as bigint) as height_emu
        from lineitem join part on l_partkey = p_partkey""",
    "v_images": "select doc_id, width_emu, height_emu, round(width_emu::double / height_emu::double, 4) as aspect from v_layout where width_emu > 0 and height_emu > 0",
    "v_comments": """
        select conv_id as doc_id, turn as seq, turn as comment_id, case when role = 'assistant' then 'qa-bot' else 'reviewer' end as author,
          case when role <> 'assistant' and conv_id % 2 = 0 and turn > 0 then turn - 1 end as parent_id,
          case when role = 'assistant' then '[RULE-PATTERN][DOC-STYLE-REWRITE-001][suggestion] Preferred rewrite: "' || substr(replace(text, '"', ''), 1, 30) || '" -> "' || substr(replace(text, '"', ''), 1, 20) || '"'
            else case conv_id % 5 when 0 then '[ACCEPT] ' when 1 then 'rejected' when 2 then 'Reject: ' when 3 then '[ Rejected ] ' else '' end
              || case when conv_id % 5 = 1 then '' else substr(text, 1, 20) end end as text
        from conversations""",
    "v_word": "select doc_id, text, case lang when 'en' then 'the' when 'fr' then 'les' when 'de' then 'und' else 'que' end as w from documents",
    "v_secrets": """
        select doc_id, text || chr(10) || case doc_id % 7 when 0 then 'key AKIA' || 'ABCDEFGHIJKLMNOP end' when 1 then 'Bearer abc.def-123= tail'
          when 2 then 'password: hunter22' when 3 then '-----BEGIN ' || 'RSA PRIVATE KEY-----' when 4 then 'eyJ' || 'abcdefghij12.abcdefghij12.abcdefghij12'
          when 5 then 'see https://example.org/a and 10.0.0.1' else 'critical  high' end as text from documents""",
    "v_phrases": "select unnest(['the objective was', 'of the', 'les', 'the', 'und']) as phrase",
    "v_tracked": """
        select doc_id, para_no, 0 as seq, 'del' as kind, trim(regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g')) as text from v_paras
        union all select doc_id, para_no, 1, 'ins', trim(regexp_replace('Revised ' || substr(text, 1, 40), '\\s+', ' ', 'g')) from v_paras where doc_id % 3 <> 0
        union all select doc_id, para_no, 2, 'ins', 'Added ' || doc_id from v_paras where doc_id % 4 = 0""",
    "v_rewrite_rules": "select distinct substr(text, 1, 40) as from_text, substr(text, 1, 30) || ' revised' as to_text from v_paras",
    "v_diagnostics": """
        select doc_id, para_no as seq, case para_no % 3 when 0 then 'suggestion' when 1 then 'warning' else 'error' end as severity,
          case para_no % 4 when 0 then 'DOC-STYLE-HYGIENE-001' when 1 then 'DOC-SENS-001' when 2 then 'LLM-NARR-001' else 'DOC-STYLE-REWRITE-001' end as code,
          'Check "' || substr(replace(text, '"', ''), 1, 25) || '" and the tone' as message,
          case when para_no % 4 = 2 then substr(text, 1, 12) || ' and Scope section' else 'Document' end as loc_section,
          case when para_no % 4 = 0 then substr(text, 5, 30) end as loc_text
        from v_paras""",
    "v_diag_rules": """
        select * from (values ('accept', 'DOC-SENS-001', 'check "'), ('reject', 'DOC-SENS-001', ''), ('reject', 'LLM-NARR-001', 'the tone'),
          ('ignore', 'DOC-STYLE-REWRITE-001', ''), ('ignore', '', 'check "the')) t(decision, code, message_contains)""",
    "v_messages": """
        select doc_id, text, 0 as nth, 'Avoid using ''' || w || ''' and "zzqq" phrasing' as message, w, '' as w2 from v_word
        union all select doc_id, text, 1, 'Use “x” instead of ‘' || case when doc_id % 2 = 0 then w else 'zzqq' end || '’ here', w, case when doc_id % 2 = 0 then w else 'zzqq' end from v_word""",
}


def with_views(body: str) -> str:
    """The statement with the derived tables it needs in front, in order of need."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_[a-z_]+\b", sql)):
            if name in VIEWS and name not in needed:
                # v_depth refers to itself.
                visit(VIEWS[name].replace(name, "")) if name == "v_depth" else visit(VIEWS[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    recursive = "recursive " if "v_depth" in needed else ""
    return f"with {recursive}" + ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed) + "\n" + body


# --- statements ---------------------------------------------------------------------------

def diag(severity: str, code: str, message: str) -> str:
    return f"'{severity}' as severity, '{code}' as code, {message} as message"


_SENTENCES = f"select doc_id, unnest({sents('text')}) as sentence, generate_subscripts({sents('text')}, 1) - 1 as sentence_no from v_secrets"

_REPEATED = f"""
    select doc_id, {diag('warning', 'DOC-STYLE-REDUND-001', "'Repeated phrase appears ' || count(*) || ' times: \"' || substr(arg_min(s, (block_no, n)), 1, 120) || '\"'")}
    from (select doc_id, block_no, unnest({sents('text')}) as s, generate_subscripts({sents('text')}, 1) as n from v_blocks)
    where length(s) >= 10 and not {has_url_or_ip('s')} group by doc_id, {bare('s')} having count(*) >= 3"""

_SECRETS = [
    ("AWS Access Key", "AKIA[0-9A-Z]{16}"),
    ("Private Key", "-----BEGIN (?:RSA|EC|OPENSSH) PRIVATE KEY-----"),
    ("JWT", r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}"),
    ("Bearer Token", r"Bearer\s+[A-Za-z0-9\-\._~\+\/]+=*"),
    ("Password Assignment", r"\bpassword\b\s*[:=]\s*[^\s]{6,}"),
    ("API Key Assignment", r"\b(?:api[_-]?key|token|secret)\b\s*[:=]\s*[^\s]{8,}"),
]
# Hits are marked in the text; what surrounds the k-th mark is the evidence.
_SENSITIVE = " union all ".join(
    f"""select doc_id, {diag('warning', 'DOC-SENS-001', repr('Possible sensitive data detected: ' + name))}, {i} as pattern_no, k as hit_no,
      {strip("right(replace(array_to_string(parts[1:k], ''), chr(2), ''), 20) || hit || left(substr(replace(array_to_string(parts[k + 1:], ''), chr(2), ''), length(hit) + 1), 20)")} as evidence
    from (select doc_id, parts, k, string_split(parts[k + 1], chr(2))[1] as hit from (
      select doc_id, parts, unnest(generate_series(1, len(parts) - 1)) as k from (
        select doc_id, string_split(regexp_replace(text, '((?is){p})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as parts from v_secrets)))"""
    for i, (name, p) in enumerate(_SECRETS)
)

# Each word's last run of word characters against the first run of the next word.
_HYGIENE_ROWS = r"""
    select *, len(list_filter(list_zip(ends[:-2], starts[2:]), lambda p: p[1] <> '' and p[1] = p[2])) > 0 as doubled from (
      select doc_id, block_no, t, list_transform(words, lambda w: lower(regexp_extract(w, '[\p{L}\p{N}_]+$'))) as ends,
        list_transform(words, lambda w: lower(regexp_extract(w, '^[\p{L}\p{N}_]+'))) as starts
      from (select *, string_split_regex(trim(t), '\s+') as words from (SOURCE)))"""


def hygiene(source: str) -> str:
    return f"""
    select doc_id, {diag('suggestion', 'DOC-STYLE-HYGIENE-001', 'issue')}, substr(t, 1, 120) as loc_text, block_no from (
      select doc_id, t, block_no, unnest(list_filter([case when doubled then 'Repeated word' end, case when contains(t, '  ') then 'Double spaces' end], lambda x: x is not null)) as issue
      from ({_HYGIENE_ROWS.replace('SOURCE', source)}))"""


_STRUCTURE = " union all ".join(
    [f"select doc_id, {diag('warning', 'FND-STRUCT-005', repr('Missing narrative section.'))}, title as loc_finding from v_finding_facts where not list_contains(fields, 'narrative')"]
    + [
        f"select doc_id, {diag(sev, code, repr('Missing ' + field.replace('_', ' ') + ' section.'))}, title as loc_finding from v_finding_facts"
        f" where threat_text <> 'Informational' and not list_contains(fields, '{field}'){extra}"
        for field, sev, code, extra in [
            ("business_impact", "error", "FND-STRUCT-001", ""),
            ("recommendations", "error", "FND-STRUCT-002", ""),
            ("evidence", "warning", "FND-STRUCT-003", " and not implicit"),
            ("reproduction", "warning", "FND-STRUCT-004", ""),
        ]
    ]
)
_QUALITY = f"""
    select doc_id, {diag('suggestion', 'FND-QUAL-003', "'Narrative appears too short for a clear story of the issue.'")}, title as loc_finding from v_finding_facts where length(narrative) < 200
    union all select doc_id, {diag('warning', 'FND-QUAL-001', "'Evidence content appears too short.'")}, title from v_finding_facts where chars < 200 and (implicit or list_contains(fields, 'evidence'))
    union all select doc_id, {diag('warning', 'FND-QUAL-002', "'Reproduction content appears too short.'")}, title from v_finding_facts where chars < 200 and list_contains(fields, 'reproduction')"""


def finding_repeats(min_len: int, min_count: int) -> str:
    return f"""
    select f.doc_id, {diag('suggestion', 'FND-QUAL-004', "'Narrative repeats a sentence ' || r.n || ' times: \"' || substr(r.s, 1, 120) || '\"'")}, f.title as loc_finding
    from (select finding_no, {bare('s')} as k, count(*) as n, arg_min(s, i) as s from
            (select finding_no, unnest({sents('narrative')}) as s, generate_subscripts({sents('narrative')}, 1) as i from v_finding_facts where narrative is not null)
          where length(s) >= {min_len} and not {has_url_or_ip('s')} group by all having count(*) >= {min_count}) r
    join v_findings f on f.finding_no = r.finding_no"""


_CVSS = f"""
    select doc_id, {diag('warning', 'FND-CONSIST-001', "'Severity \"' || threat_text || '\" does not match CVSS ' || printf('%.1f', score) || ' (expected ' || band || ').'")}, title as loc_finding
    from (select *, {band('score')} as band from (select *, {score('cvss_text')} as score from v_findings))
    where threat_text <> 'Informational' and band <> threat_text"""

_BLANK = f"""
    select doc_id, {diag('warning', 'DOC-FMT-PAGE-001', "'Likely blank page(s) detected around manual page breaks (count ' || count(*) || ').'")}
    from (select doc_id, segment, count(*) filter (not has_break and text <> '') as said
          from (select *, count(*) filter (has_break) over (partition by doc_id order by para_no) as segment from v_breaks) group by all) s
    where segment >= 1 and said = 0 and exists (select 1 from (select doc_id, count(*) as n from v_breaks where has_break group by doc_id) b where b.doc_id = s.doc_id and b.n > s.segment)
    group by doc_id"""

_INDEX = f"""
    select doc_id, {diag('suggestion', 'DOC-FMT-INDEX-001', "'\"' || text || '\" is not using a heading style; it may not appear correctly in the index/TOC.'")}, text as loc_text
    from v_blocks where lower(text) in ('list of figures', 'list of tables', 'table of contents') and level is null"""

_SUPPRESSED = f"""
    exists (select 1 from v_diag_rules r where r.decision = 'accept' and (r.code = '' or r.code = d.code) and contains({squash('d.message')}, {squash('r.message_contains')}))
    or not exists (select 1 from v_diag_rules r where r.decision in ('reject', 'ignore') and (r.code = '' or r.code = d.code) and contains({squash('d.message')}, {squash('r.message_contains')}))"""

_NO_FINDING = "select doc_id, severity, code, message"
_SCAN = f"""
    select d.doc_id, row_number() over (partition by d.doc_id order by check_no, pos, message, evidence nulls first) as seq, severity, code, message from (
      select *, 1 as check_no, 0 as pos, null as evidence from ({_BLANK})
      union all select doc_id, severity, code, message, 2, 1, null from ({_INDEX})
      union all select doc_id, severity, code, message, 3, pos, null from ({_REPEATED.replace("select doc_id, 'warning'", "select doc_id, min(block_no) as pos, 'warning'", 1)})
      union all select doc_id, severity, code, message, 4, pattern_no * 1099511627776 + hit_no, null from ({_SENSITIVE})
      union all select doc_id, severity, code, message, 5, block_no, null from ({hygiene('select doc_id, block_no, text as t from v_blocks')})
      union all select doc_id, severity, code, message, 13, cast(substr(loc_finding, 9) as bigint), null from ({_STRUCTURE})
      union all select doc_id, severity, code, message, 14, cast(substr(loc_finding, 9) as bigint), null from ({_QUALITY})
      union all select doc_id, severity, code, message, 15, cast(substr(loc_finding, 9) as bigint), null from ({finding_repeats(10, 3)})
      union all select doc_id, severity, code, message, 16, cast(substr(loc_finding, 9) as bigint), null from ({_CVSS})) d
    where {_SUPPRESSED}"""


def phrase_checks(code: str, template: str, phrases: str) -> str:
    return f"""
    select doc_id, 'suggestion' as severity, '{code}' as code, '{template}: "' || shown || '" (count ' || n || ')' as message
    from (select t.doc_id, p.shown, {count_of('lower(t.text)', 'p.phrase')} as n from v_texts t, ({phrases}) p) where n > 4"""


def strange(column: str, shown: str, share: str, at_least: int, code: str, message: str) -> str:
    return f"""
    select doc_id, 'suggestion' as severity, '{code}' as code, '{message}: ' || string_agg({shown}, ', ' order by n desc, {column}) || '.' as message
    from (select *, row_number() over (partition by doc_id order by n desc, {column}) as rank from
           (select doc_id, {column}, count(*) as n from v_layout group by all having count(*) >= {at_least})
          where {column} not in (select {column} from v_layout group by 1 having count(*) >= 2 and count(*)::double / (select count(*) from v_layout) >= {share}::double))
    where rank <= 4 group by doc_id"""


def rank_values(column: str) -> str:
    return f"""
    select cast(v[cast(floor(n * 0.1::double) as bigint) + 1] as double) as low, cast(v[n // 2 + 1] as double) as median,
      cast(v[cast(floor(n * 0.9::double) as bigint) + 1] as double) as high, n as samples
    from (select list({column} order by {column}) as v, count(*) as n from v_images)"""


_SIDE_SENTENCES = f"""
    select {squash('s')} as phrase, old, new from (
      select unnest({sents('t.text')}) as s, 1 as old, 0 as new from v_pairs p join v_texts t on t.doc_id = p.old_doc
      union all select unnest({sents('t.text')}), 0, 1 from v_pairs p join v_texts t on t.doc_id = p.new_doc)"""


def grams(x: str, n: int) -> str:
    w = f"regexp_extract_all(lower({x}), '[a-z'']+')"
    return f"list_transform(generate_series(1, len({w}) - {n - 1}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


def gram_rows(source: str) -> str:
    """phrase rows for n = 3, 4, 5 of (keys, words) rows without quadratic list slicing."""
    return f"""
    select * exclude (a, b, c, d, e), a || ' ' || b || ' ' || c as phrase from ({source}) where c is not null
    union all select * exclude (a, b, c, d, e), a || ' ' || b || ' ' || c || ' ' || d from ({source}) where d is not null
    union all select * exclude (a, b, c, d, e), a || ' ' || b || ' ' || c || ' ' || d || ' ' || e from ({source}) where e is not null"""


_DOC_WORDS = """
    select doc_id, w as a, lead(w, 1) over o as b, lead(w, 2) over o as c, lead(w, 3) over o as d, lead(w, 4) over o as e from (
      select doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) as w, generate_subscripts(regexp_extract_all(lower(text), '[a-z'']+'), 1) as i from v_texts)
    window o as (partition by doc_id order by i)"""
_GRAM_COUNTS = f"select doc_id, phrase, count(*) as n from ({gram_rows(_DOC_WORDS)}) group by all"
_GRAM_DROPS = f"""
    select phrase, cast(sum(case when side = 'old' then n else 0 end) as bigint) as old, cast(sum(case when side = 'new' then n else 0 end) as bigint) as new
    from (select 'old' as side, old_doc as doc_id from v_pairs union all select 'new', new_doc from v_pairs) s join ({_GRAM_COUNTS}) g using (doc_id) group by phrase"""

_CASE_ROWS = """
    select p.pair_id, o.text as old_text, n.text as preferred, lower(n.text) as lower, n.para_no
    from v_pairs p join v_versions_case o on o.doc_id = p.old_doc join v_versions_case n on n.doc_id = p.new_doc and lower(n.text) = lower(o.text)
    where not exists (select 1 from v_versions_case x where x.doc_id = p.new_doc and x.text = o.text)
      and not exists (select 1 from v_versions_case x where x.doc_id = p.old_doc and x.text = n.text)"""
_CASE = f"""
    select lower, arg_min(preferred, (-votes, pair_id, para_no, preferred)) as preferred, max(votes) as votes
    from (select lower, preferred, count(*) as votes, min((pair_id, para_no)).pair_id as pair_id, min((pair_id, para_no)).para_no as para_no
          from (select lower, preferred, pair_id, para_no from ({_CASE_ROWS})) group by lower, preferred) group by lower"""
_CASE = _CASE.replace("min((pair_id, para_no)).pair_id", "min(pair_id)").replace("min((pair_id, para_no)).para_no", "arg_min(para_no, (pair_id, para_no))")

_TRACKED_PAIRS = """
    select d.doc_id, d.para_no, cast(min(i.seq) as integer) as seq, d.text as from_text, arg_min(i.text, i.seq) as to_text
    from v_tracked d join v_tracked i on i.doc_id = d.doc_id and i.para_no = d.para_no and i.kind = 'ins' where d.kind = 'del' group by d.doc_id, d.para_no, d.text"""
_ROLES = "select old_doc as doc_id from v_pairs union all select new_doc from v_pairs"

_RESOLVED = f"""
    select c.doc_id, c.seq, 'DOC-STYLE-REWRITE-001' as code, c.text, coalesce({decision('c.text')},
        (select arg_min({decision('r.text')}, r.seq) from v_comments r where r.doc_id = c.doc_id and r.parent_id = c.comment_id and {decision('r.text')} is not null),
        (select arg_min({decision('o.text')}, o.seq) from v_comments o where o.doc_id = c.doc_id and o.seq > c.seq and o.seq <= c.seq + 6 and o.parent_id is null
           and o.author <> 'qa-bot' and o.comment_id - c.comment_id <= 8 and {decision('o.text')} is not null)) as decision
    from v_comments c where c.author = 'qa-bot'"""
_PAIR = r'"([^"]+)"\s*(?:->|=>)\s*"([^"]+)"'
_STRAIGHT = "translate(text, '“”‘’', '\"\"''''')"
_COMMENT_PAIRS = f"""
    select doc_id, seq, {strip(f"regexp_extract({_STRAIGHT}, '{_PAIR}', 1)")} as from_text, {strip(f"regexp_extract({_STRAIGHT}, '{_PAIR}', 2)")} as to_text
    from v_comments where regexp_matches({_STRAIGHT}, '{_PAIR}')"""

_CANDIDATES = f"""
    select doc_id, seq, 2 as rung, 0 as nth, false as whole, {strip('loc_text')} as needle from v_diagnostics where loc_text is not null
    union all select doc_id, seq, 3, 0, true, {strip('loc_section')} from v_diagnostics where loc_section <> 'Document'
    union all select doc_id, seq, 4, unnest(range(len(h))), true, unnest(h) from (select doc_id, seq, {hints('loc_section')} as h from v_diagnostics where loc_section <> 'Document')
    union all select doc_id, seq, 6, 0, false, {strip("regexp_extract(message, '\"([^\"]+)\"', 1)")} from v_diagnostics"""
_FOUND = f"""
    select c.doc_id, c.seq, c.rung, c.nth,
      case when whole then coalesce(min(p.para_no) filter (p.text = needle), min(p.para_no) filter (lower(p.text) = lower(needle)), min(p.para_no) filter (contains(p.text, needle)), min(p.para_no))
        else coalesce(min(p.para_no) filter (contains(p.text, needle)), min(p.para_no)) end as para_no
    from ({_CANDIDATES}) c join (select doc_id, para_no, {strip('text')} as text from v_paras) p on p.doc_id = c.doc_id and contains(lower(p.text), lower(c.needle))
    where needle <> '' group by c.doc_id, c.seq, c.rung, c.nth, c.whole
    union all
    select c.doc_id, c.seq, 5, c.nth, min(p.para_no) from (
      select doc_id, seq, unnest(range(len(h))) as nth, regexp_extract_all(unnest(h), '[a-z0-9]{{4,}}') as tokens from (select doc_id, seq, {hints('loc_section')} as h from v_diagnostics where loc_section <> 'Document')) c
    join v_paras p on p.doc_id = c.doc_id
    where len(list_filter(c.tokens, lambda w: contains(lower(p.text), w))) >= greatest(2, least(3, len(c.tokens))) group by all"""
_ANCHORED = f"""
    select d.doc_id, d.seq, coalesce(b.para_no, f.first_no) as para_no, coalesce(b.rung, 7) as rung
    from v_diagnostics d
    left join (select doc_id, seq, arg_min(para_no, (rung, nth)) as para_no, min(rung) as rung from ({_FOUND}) group by all) b on b.doc_id = d.doc_id and b.seq = d.seq
    join (select doc_id, min(para_no) as first_no from v_paras group by doc_id) f on f.doc_id = d.doc_id"""

_WORD_COUNT = count_of("lower(text)", "w")
_MAX_COUNT = f"case when nth = 0 then {_WORD_COUNT} else 0 end"

def support(source: str) -> str:
    """The supporting sentence of each (doc_id, text, message, hint, quote) row."""
    wanted = f"list_distinct(list_concat({overlap_words('hint')}, {overlap_words('message')}))"
    return f"""
    select doc_id, message, coalesce(arg_min(s, i) filter (quoted), arg_min(s, (-score, i)) filter (own > 0), arg_min(s, i)) as sentence from (
      select doc_id, message, s, i, len(list_intersect({wanted}, {overlap_words('s')})) as score, len({overlap_words('s')}) as own,
        coalesce(contains(lower(s), lower(quote)), false) as quoted
      from (select doc_id, message, hint, nullif(quote, '') as quote, unnest({sents('text')}) as s, generate_subscripts({sents('text')}, 1) as i from ({source})))
    group by doc_id, message"""


_SUPPORT_SOURCE = r"""
    select *, case when doc_id % 2 = 0 then regexp_replace(q, '^\s+|\s+$', '', 'g') end as quote from (
      select doc_id, text, 'Narrative' as hint, replace(substr(text, 40, 8), '"', ' ') as q,
        case when doc_id % 2 = 0 then 'About "' || replace(substr(text, 40, 8), '"', ' ') || '" here' else 'about ' || substr(text, 60, 60) end as message from v_texts)"""
_EXAMPLE_SOURCE = "select doc_id, text, 'Narrative' as hint, null as quote, 'Stating the obvious: ' || substr(text, 30, 40) as message from v_texts"


_SECTION_LINES = """
    select m.doc_id, m.section_no as match_no, x.section_no, b.block_no, b.text as line
    from v_tree m join v_tree x on x.doc_id = m.doc_id left join v_tree y on y.doc_id = x.doc_id and y.section_no = x.parent_no
    join v_sections_raw b on b.doc_id = x.doc_id and b.section_no = x.section_no
    where contains(lower(m.title), '{keyword}') and m.section_no in (x.section_no, x.parent_no, y.parent_no) and (b.level is null or x.section_no <> m.section_no)"""
_NARRATIVES = f"""
        select t.doc_id, coalesce(nullif(a.x, ''), nullif(b.x, ''), t.text) as narrative from v_texts t
        left join (select doc_id, string_agg(line, chr(10) order by match_no, block_no) as x from ({_SECTION_LINES.format(keyword='narrative')}) group by 1) a on a.doc_id = t.doc_id
        left join (select doc_id, string_agg(narrative, chr(10) order by finding_no) as x from v_finding_facts where narrative is not null group by 1) b on b.doc_id = t.doc_id"""
_REVIEWED = f"select t.doc_id, t.narrative as text, w.w from ({_NARRATIVES}) t join v_word w on w.doc_id = t.doc_id where t.doc_id % 5 <> 4"

_PROFILE_SENTENCES = f"select phrase, sum(old) as old, sum(new) as new from ({_SIDE_SENTENCES}) group by phrase having sum(old) - sum(new) >= 1 and length(phrase) >= 20"

_GUIDE_PARTS = f"""
    select concat_ws(chr(10),
      (select 'Avoid overused/deprecated phrasing like: ' || string_agg(phrase, ', ' order by drop_n desc, old desc, phrase) || '.' from
         (select * from (select phrase, old - new as drop_n, old from ({_GRAM_DROPS}) where old - new >= 4 order by drop_n desc, old desc, phrase limit 12)
          where not (contains(phrase, 'und') or contains('und', phrase)))),
      (select 'AI-learned deprecated phrasing to avoid: ' || string_agg(phrase, ', ' order by votes desc, phrase) || '.' from
         (select * from (select * from (
            select 'of the' as phrase, count(*) as votes from v_pairs where family_no % 5 <> 4
            union all select d.lang, count(*) from v_pairs p join documents d on d.doc_id = p.new_doc where family_no % 5 <> 4 group by 1) where votes >= 2 order by votes desc, phrase limit 12)
          where not (contains(phrase, 'und') or contains('und', phrase)))),
      (select 'Preferred rewrite patterns:' || chr(10) || '- ' || string_agg(line, chr(10) || '- ' order by from_text, line) from
         (select '"' || from_text || '" -> "' || to_text || '"' as line, from_text from
           (select arg_min(from_text, (from_text, to_text)) as from_text, arg_min(to_text, (from_text, to_text)) as to_text from v_rewrite_rules
            group by {squash('from_text')}, {squash('to_text')}) where {high_signal('from_text', 'to_text')} order by from_text, line limit 8)),
      'AI-learned style rules:' || chr(10) || '- Use active voice.') as guidance"""

_PAIR_SENTENCES = f"""
    select p.pair_id, side, pos, sentence from (
      select pair_id, old_doc as doc_id, 'old' as side from v_pairs union all select pair_id, new_doc, 'new' from v_pairs) p
    join (select doc_id, unnest({sents('text')}) as sentence, generate_subscripts({sents('text')}, 1) as pos from v_texts) t on t.doc_id = p.doc_id"""

# The longest shared run first, then the longest on either side of it, and so on: ranges are split in a recursion.
# Sentences that make up over a hundredth of a long version start no run; here they extend none either.
_CHANGES = f"""
    with recursive said as materialized (select pair_id, side, pos - 1 as pos, sentence from ({_PAIR_SENTENCES})),
    sizes as (select pair_id, count(*) filter (side = 'old') as o, count(*) filter (side = 'new') as n from said group by pair_id),
    rare as (select pair_id, sentence from said join sizes using (pair_id) group by pair_id, sentence
      having max(n) < 200 or count(*) filter (side = 'new') <= max(n) // 100 + 1),
    same as (select a.pair_id, a.pos as i, b.pos as j from said a join said b on a.pair_id = b.pair_id and a.sentence = b.sentence and a.side = 'old' and b.side = 'new'
      where (a.pair_id, a.sentence) in (select (pair_id, sentence) from rare)),
    runs as materialized (select pair_id, min(i) as i, min(j) as j, count(*) as n from (
      select *, i - row_number() over (partition by pair_id, i - j order by i) as island from same) group by pair_id, i - j, island),
    ranges as (
      select r.pair_id, 0::bigint as a, z.o as a_end, 0::bigint as b, z.n as b_end, arg_min(struct_pack(i := i, j := j, n := r.n), (-r.n, i, j)) as best
      from runs r join sizes z using (pair_id) group by all
      union all
      select pair_id, a, a_end, b, b_end, arg_min(struct_pack(i := start, j := start - d, n := n), (-n, start, start - d)) from (
        select c.*, r.i - r.j as d, greatest(r.i, c.a, c.b + r.i - r.j) as start, least(r.i + r.n, c.a_end, c.b_end + r.i - r.j) - greatest(r.i, c.a, c.b + r.i - r.j) as n
        from (select pair_id, a, best.i as a_end, b, best.j as b_end from ranges
              union all select pair_id, best.i + best.n, a_end, best.j + best.n, b_end from ranges) c join runs r using (pair_id))
      where n > 0 group by pair_id, a, a_end, b, b_end),
    kept as (select pair_id, best.i as i, best.j as j, best.n as n from ranges union all select pair_id, o, n, 0 from sizes),
    gaps as (select pair_id, i as a_end, j as b_end, coalesce(lag(i + n) over w, 0) as a, coalesce(lag(j + n) over w, 0) as b from kept window w as (partition by pair_id order by i, j)),
    places as (
      select pair_id, 'replaced' as kind, a + k as old_pos, b + k as new_pos from (select *, unnest(range(least(a_end - a, b_end - b))) as k from gaps where a < a_end and b < b_end)
      union all select pair_id, 'removed', unnest(range(a, a_end)), null from gaps where b = b_end
      union all select pair_id, 'added', null, unnest(range(b, b_end)) from gaps where a = a_end)
    select p.pair_id, kind, row_number() over (partition by p.pair_id order by coalesce(old_pos, anchor_old), coalesce(new_pos, 0)) - 1 as seq, o.sentence as old_sentence, n.sentence as new_sentence
    from (select p.*, g.a_end as anchor_old from places p left join gaps g on g.pair_id = p.pair_id and p.kind = 'added' and p.new_pos >= g.b and p.new_pos < g.b_end) p
      left join said o on o.pair_id = p.pair_id and o.side = 'old' and o.pos = old_pos
      left join said n on n.pair_id = p.pair_id and n.side = 'new' and n.pos = new_pos
    where kind <> 'replaced' or o.sentence <> n.sentence"""

_LINES = """
    select doc_id, unnest(string_split(text, chr(10))) as line, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as bigint) as no from documents"""

STATEMENTS = {
    "ingest_blocks": """
        select doc_id, row_number() over (partition by doc_id order by para_no) - 1 as block_no, 'p' as type, text,
          case when para_no % 6 = 0 then 'heading ' || (1 + (para_no // 6) % 3) end as style_name, case when para_no % 6 = 0 then 1 + (para_no // 6) % 3 end as heading_level from v_paras""",
    "ingest_layout": f"""
        with l as ({_LINES})
        select doc_id, 'style' as kind, case when no % 6 = 0 then 'H' || (1 + (no // 6) % 3) else '(no-style)' end as value, count(*) as n from l group by all
        union all select doc_id, 'alignment', case when no % 3 = 0 then 'both' else 'default' end, count(*) from l group by all
        union all select doc_id, 'table_columns', cast(2 + count(*) % 3 as varchar), 1 from l group by doc_id
        union all select doc_id, 'image', 'images', count(*) from l where no % 11 = 5 group by doc_id""",
    "ingest_breaks": f"select doc_id, no as para_no, trim(line) as text, no % 5 = 4 as has_break from ({_LINES})",
    "ingest_comments": f"""
        select doc_id, 0::bigint as seq, count(*) as comment_id, null::bigint as parent_id, 'lead' as author, 'ACCEPT ' || count(*) || ' lines' as text
        from ({_LINES}) group by doc_id""",
    "ingest_tracked": f"""
        select doc_id, no as para_no, 0::bigint as seq, 'del' as kind, 'gone ' || no as text from ({_LINES}) where no % 7 = 3
        union all select doc_id, no, 1, 'ins', '' from ({_LINES}) where no % 7 = 3""",
    "layout_snapshot": """
        select doc_id, 'style' as kind, style_id as value, count(*) as n from v_layout group by all
        union all select doc_id, 'alignment', alignment, count(*) from v_layout group by all
        union all select doc_id, 'table_columns', cast(columns as varchar), count(*) from v_layout group by all
        union all select doc_id, 'image', 'images', count(*) from v_images group by all""",
    "tracked_pairs": _TRACKED_PAIRS,
    "config_rules": """
        select doc_id, 'deprecated_phrase' as kind, 0 as pos, lang as a, '' as b from documents
        union all select doc_id, 'deprecated_phrase', 2, '7', '' from documents
        union all select doc_id, 'rewrite_accept', 0, lang, source from documents
        union all select doc_id, 'diagnostic_reject', 0, 'C' || doc_id, '' from documents""",
    "scan_report": _SCAN,
    "heading_levels": "select doc_id, block_no, level as heading_level from v_blocks",
    "sections": "select doc_id, section_no, parent_no, level, title from v_tree",
    # open: no section of its level or a smaller one has come since
    "deep_sections": """
        select * from (with b as (select doc_id, para_no, case when para_no % 2 = 1 then 1 + (para_no * para_no * 7 + doc_id) % 40 end as level from v_paras),
        n as (select *, count(level) over (partition by doc_id order by para_no) as section_no from b),
        s as (select doc_id, section_no, level from n where level is not null union all select distinct doc_id, section_no, 0 from n where section_no = 0),
        e as (select s.*, min(t.section_no) as closed from s left join s t on t.doc_id = s.doc_id and t.section_no > s.section_no and t.level <= s.level group by all)
        select s.doc_id, s.section_no, s.level, coalesce(string_agg(cast(e.section_no as varchar), '>' order by e.section_no), '') as path
        from s left join e on e.doc_id = s.doc_id and e.section_no < s.section_no and e.level < s.level and coalesce(e.closed, s.section_no + 1) > s.section_no
        group by all)""",
    "section_depth": "select doc_id, section_no, depth from v_depth",
    "section_text": _SECTION_LINES.format(keyword="on"),
    # A finding's paragraphs include the title of the next one in the same report.
    "findings": """
        select f.doc_id, row_number() over (partition by f.doc_id order by f.finding_no) as finding_no, f.title, f.threat_text, f.cvss_text,
          coalesce(l.n, 0) + case when lead(f.finding_no) over (partition by f.doc_id order by f.finding_no) is null then 0 else 1 end as n_lines
        from v_findings f left join (select finding_no, count(*) as n from v_finding_lines group by 1) l on l.finding_no = f.finding_no""",
    "table_values": "select doc_id, finding_no * 1000000 + 1 as block_no, threat_text, cvss_text, null::varchar as owner from v_findings",
    "finding_fields": "select finding_no, field, line_no, line from v_fields",
    "implicit_evidence": "select finding_no, implicit as has_evidence from v_finding_facts where finding_no in (select finding_no from v_finding_lines)",
    "threat_level": f"""
        select finding_no, {threat("x")} as threat, null::varchar as none from (
          select finding_no, case finding_no % 3 when 0 then 'low risk, threat  level = ' when 1 then 'rated ' else 'threat-' end || lower(threat_text) || ' as of now' as x from v_findings)""",
    "severity": rf"select finding_no, case when threat_text <> 'Informational' then threat_text end as severity from v_findings",
    "cvss_score": f"select finding_no, {score('cvss_text')} as score from v_findings",
    "cvss_band": f"select finding_no, {band('s')} as band from (select finding_no, {score('cvss_text')} as s from v_findings)",
    "sentences": _SENTENCES,
    "normalized_sentences": f"select doc_id, sentence_no, {bare('sentence')} as bare, {squash('sentence')} as squashed from ({_SENTENCES})",
    "url_or_ip": f"select doc_id, sentence_no, {has_url_or_ip('sentence')} as found from ({_SENTENCES})",
    "rewrite_tokens": f"select doc_id, para_no, array_to_string({rewrite_words('text')}, ' ') as tokens from v_paras",
    "high_signal": f"select from_text, to_text, {high_signal('from_text', 'to_text')} as high from v_rewrite_rules",
    "ngram_counts": f"select phrase, cast(sum(n) as bigint) as n from ({_GRAM_COUNTS}) group by phrase",
    "quoted_phrases": f"""
        select doc_id, seq, row_number() over (partition by doc_id, seq order by i) - 1 as nth, phrase from (
          select doc_id, seq, {squash('p')} as k, arg_min({strip('p')}, i) as phrase, min(i) as i from (
            select doc_id, seq, unnest({quoted('x')}) as p, generate_subscripts({quoted('x')}, 1) as i from (select doc_id, seq, text || ' ''one thing'' “One  Thing” ‘two’' as x from v_comments))
          where {squash('p')} <> '' group by all)""",
    "phrase_counts": f"select * from (select t.doc_id, p.phrase, {count_of('lower(t.text)', 'p.phrase')} as n from v_texts t, v_phrases p) where n > 0",
    "overlap_tokens": f"select doc_id, para_no, array_to_string(list_sort({overlap_words('text')}), ' ') as tokens from v_paras",
    "supporting_sentence": f"select doc_id, sentence from ({support(_SUPPORT_SOURCE)})",
    "phrase_matches": f"""
        select distinct text as phrase from v_paras t where exists (select 1 from v_phrases p where contains({squash('t.text')}, p.phrase) or contains(p.phrase, {squash('t.text')}))""",
    "llm_payload": "select doc_id, doc_id % 5 <> 4 as has_payload, case when doc_id % 5 <> 4 then 3 end as n_issues from documents",
    "rubric_rating": "select doc_id, case when doc_id % 9 = 0 then 'Weak' when doc_id % 27 >= 19 then 'Strong' when doc_id % 27 >= 10 then 'Fair' else 'Weak' end as rating from documents",
    "check_blank_pages": _BLANK,
    "check_index_headings": _INDEX,
    "check_repetition": _REPEATED,
    "check_sensitive": f"select doc_id, severity, code, message, evidence from ({_SENSITIVE})",
    "check_hygiene": f"select doc_id, severity, code, message, loc_text from ({hygiene('select doc_id, 0 as block_no, unnest(string_split(text, chr(10))) as t from v_secrets')})",
    "check_deprecated_ngrams": phrase_checks("DOC-STYLE-DEPRECATED-001", "Deprecated phrase found", "select phrase, phrase as shown from v_phrases where phrase <> 'les'"),
    "check_deprecated_ai": phrase_checks(
        "DOC-STYLE-DEPRECATED-AI-001", "AI-learned deprecated phrase found",
        "select phrase, array_to_string(list_transform(string_split(phrase, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as shown from v_phrases",
    ),
    "check_case": """
        select doc_id, 'suggestion' as severity, 'DOC-STYLE-CASE-001' as code, 'Preferred casing: "' || shown || '"' as message from v_texts t,
          (select phrase, array_to_string(list_transform(string_split(phrase, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as shown from v_phrases) p
        where contains(lower(text), phrase) and not contains(text, shown)""",
    "check_rewrites": f"""
        select t.doc_id, 'suggestion' as severity, 'DOC-STYLE-REWRITE-001' as code, 'Preferred rewrite: "' || from_text || '" -> "' || to_text || '"' as message,
          case when length(from_text) >= 8 then from_text end as loc_text
        from (select doc_id, {squash('text')} as text from v_texts) t,
          (select *, {squash('from_text')} as a, {squash('to_text')} as b from v_rewrite_rules where {high_signal('from_text', 'to_text')}) r
        where not (contains(a, 'und') or contains('und', a)) and contains(t.text, a) and not contains(t.text, b)""",
    "check_paragraph_styles": strange("style_id", "style_id || ' (' || n || 'x)'", "0.03", 3, "DOC-FMT-PARA-001", "Paragraph styles outside learned baseline"),
    "check_table_columns": strange("columns", "columns || ' cols (' || n || 'x)'", "0.2", 2, "DOC-FMT-TBL-001", "Table column patterns outside learned baseline"),
    "check_image_widths": f"""
        select doc_id, 'suggestion' as severity, 'DOC-FMT-IMG-001' as code,
          'Found ' || count(*) || ' image(s) outside learned width range (' || cast(r.low as bigint) || '-' || cast(r.high as bigint) || ' EMU).' as message
        from v_images i, ({rank_values('width_emu')}) r where width_emu < floor(r.low * 0.9::double) or width_emu > floor(r.high * 1.1::double) group by doc_id, r.low, r.high""",
    "check_finding_structure": _STRUCTURE,
    "check_finding_quality": _QUALITY,
    "check_finding_repetition": finding_repeats(8, 2),
    "check_cvss_consistency": _CVSS,
    "suppress_diagnostics": f"select doc_id, seq, code, message from v_diagnostics d where {_SUPPRESSED}",
    "report_versions": "select doc_id, file_name, 'report' || family as family, 0 as major, version as minor from v_versions",
    "pairs_consecutive": "select pair_id, family, old_doc, new_doc from v_pairs",
    "pairs_latest": """
        select arg_min(file_name, version) || '::' || arg_max(file_name, version) as pair_id, 'report' || family as family, arg_min(doc_id, version) as old_doc, arg_max(doc_id, version) as new_doc
        from v_versions group by v_versions.family having count(*) >= 2""",
    "deprecated_sentences": f"select phrase, cast(old as bigint) as old, cast(new as bigint) as new from ({_PROFILE_SENTENCES})",
    "deprecated_ngrams": f"select * from ({_GRAM_DROPS}) where old - new >= 4",
    "case_normalization": _CASE,
    "tracked_signals": f"""
        select 'sentence' as kind, phrase as a, '' as b, cast(sum(old) as bigint) as old, cast(sum(new) as bigint) as new from (
          select phrase, old, new from ({_SIDE_SENTENCES})
          union all select {squash('s')}, case when kind = 'del' then 2 else 0 end, case when kind = 'ins' then 2 else 0 end from (
            select kind, unnest({sents('t.text')}) as s from v_tracked t join ({_ROLES}) r on r.doc_id = t.doc_id)) group by phrase
        union all
        select 'ngram', phrase, '', cast(sum(old) as bigint), cast(sum(new) as bigint) from (
          select phrase, old, new from ({_GRAM_DROPS})
          union all select phrase, case when kind = 'del' then 1 else 0 end, case when kind = 'ins' then 1 else 0 end from (
            {" union all ".join(f"select kind, unnest({grams('t.text', n)}) as phrase from v_tracked t join ({_ROLES}) r on r.doc_id = t.doc_id" for n in (3, 4, 5))})) group by phrase
        union all
        select 'rewrite', {squash('from_text')}, {squash('to_text')}, 0, cast(2 * count(*) as bigint) from ({_TRACKED_PAIRS}) t join ({_ROLES}) r on r.doc_id = t.doc_id where from_text <> to_text group by 2, 3""",
    "ai_votes": """
        select * from (
          select 'phrase' as kind, 'of the' as a, '' as b, count(*) as votes from v_pairs where family_no % 5 <> 4
          union all select 'phrase', d.lang, '', count(*) from v_pairs p join documents d on d.doc_id = p.new_doc where family_no % 5 <> 4 group by all
          union all select 'rule', 'Use active voice.', '', count(*) from v_pairs where family_no % 5 <> 4
          union all select 'rewrite', 'the tested device unit', 'the tested unit', count(*) from v_pairs where family_no % 5 <> 4) where votes >= 2""",
    "change_samples": f"select *, row_number() over (partition by pair_id, kind order by seq) as nth from ({_CHANGES})",
    "aligned_rewrites": f"""
        select arg_min(old_sentence, (pair_id, seq)) as from_text, arg_min(new_sentence, (pair_id, seq)) as to_text, count(*) as votes
        from ({_CHANGES}) where kind = 'replaced' and {squash('old_sentence')} <> {squash('new_sentence')} and {high_signal('old_sentence', 'new_sentence')}
        group by {squash('old_sentence')}, {squash('new_sentence')}""",
    "preferred_rewrites": f"""
        select arg_min(from_text, (priority, -votes, from_text, to_text)) as from_text, arg_min(to_text, (priority, -votes, from_text, to_text)) as to_text,
          arg_min(votes, (priority, -votes, from_text, to_text)) as votes, min(priority) as priority
        from (select from_text, to_text, 9999::bigint as votes, 0 as priority from v_rewrite_rules
              union all select arg_min(from_text, (pair_id, stage, para_no)), arg_min(to_text, (pair_id, stage, para_no)), 2 * count(*), 1
                from ({_TRACKED_PAIRS}) t join (select pair_id, 1 as stage, old_doc as doc_id from v_pairs union all select pair_id, 2, new_doc from v_pairs) r on r.doc_id = t.doc_id
                where from_text <> to_text group by {squash('from_text')}, {squash('to_text')})
        where {squash('from_text')} <> '' and {squash('to_text')} <> '' group by {squash('from_text')}, {squash('to_text')}""",
    "format_rules_styles": " union all ".join(
        f"select '{kind}' as kind, cast({column} as varchar) as value, count(*) as n, round(count(*)::double / (select count(*) from v_layout), 4) as share from v_layout group by 2"
        f" having count(*) >= 2 and count(*)::double / (select count(*) from v_layout) >= {share}::double"
        for kind, column, share in [("style", "style_id", 0.03), ("alignment", "alignment", 0.03), ("columns", "columns", 0.2)]
    ),
    "format_rules_images": f"select 'width_emu' as kind, * from ({rank_values('width_emu')}) union all select 'aspect', * from ({rank_values('aspect')})",
    "change_profile": f"""
        select pair_id, 'sentence' as kind, phrase, old as old_n, new as new_n, null::varchar as preferred from (
          select pair_id, {squash('s')} as phrase, count(*) filter (side = 'old') as old, count(*) filter (side = 'new') as new from (
            select pair_id, 'old' as side, unnest({sents('t.text')}) as s from v_pairs p join v_texts t on t.doc_id = p.old_doc
            union all select pair_id, 'new', unnest({sents('t.text')}) from v_pairs p join v_texts t on t.doc_id = p.new_doc) group by all) where old - new >= 1 and length(phrase) >= 15
        union all
        select pair_id, 'ngram', phrase, cast(coalesce(sum(n) filter (side = 'old'), 0) as bigint) as o, cast(coalesce(sum(n) filter (side = 'new'), 0) as bigint) as w, null
        from (select pair_id, 'old' as side, old_doc as doc_id from v_pairs union all select pair_id, 'new', new_doc from v_pairs) s join ({_GRAM_COUNTS}) g using (doc_id)
        group by pair_id, phrase having coalesce(sum(n) filter (side = 'old'), 0) - coalesce(sum(n) filter (side = 'new'), 0) >= 1
        union all
        select pair_id, 'case', lower, null, null, arg_max(preferred, para_no) from ({_CASE_ROWS}) group by pair_id, lower""",
    "refreshed_totals": f"select phrase, cast(sum(old) as bigint) as old, cast(sum(new) as bigint) as new from ({_SIDE_SENTENCES}) group by phrase",
    "incremental_refresh": """
        select pair_id, case new_doc % 5 when 0 then 'reused_stat' when 1 then 'reused_hash' else 'recomputed' end as status from v_pairs
        union all select pair_id || ' gone', 'stale' from v_pairs where new_doc % 5 = 4""",
    "comment_decisions": f"select doc_id, seq, {decision('text')} as decision from v_comments",
    "comment_rewrites": _COMMENT_PAIRS,
    "comment_diag_rules": r"""
        select doc_id, seq, trim(regexp_extract(text, '(?s)^\[[^\]]+\]\[([^\]]+)\]\[[^\]]+\]\s*(.*)$', 1)) as code,
          rtrim(substr(trim(regexp_replace(regexp_extract(text, '(?s)^\[[^\]]+\]\[([^\]]+)\]\[[^\]]+\]\s*(.*)$', 2), '\s+', ' ', 'g')), 1, 220)) as message_contains
        from v_comments where regexp_matches(text, '(?s)^\[[^\]]+\]\[([^\]]+)\]\[[^\]]+\]')""",
    "resolve_feedback": f"select doc_id, seq, decision, code from ({_RESOLVED}) where decision is not null",
    "merge_feedback": f"""
        select * from (with reviewed as (select r.doc_id, r.seq, r.decision, p.from_text, p.to_text from ({_RESOLVED}) r join ({_COMMENT_PAIRS}) p on p.doc_id = r.doc_id and p.seq = r.seq where r.decision is not null),
        rules as (select r.decision, squashed from (select doc_id, seq, decision, {squash("regexp_extract(text, '(?s)^(?:[^]]*[]]){3}(.*)$', 1)")} as squashed from ({_RESOLVED})) r where r.decision is not null)
        select 'rewrite' as kind, decision, count(*) filter (not known) as added, any_value(kept) as kept
        from (select decision, {squash('from_text')} as a, {squash('to_text')} as b, bool_or(doc_id % 2 = 0) as known from reviewed group by all)
        join (select decision, count(distinct (from_text, to_text)) filter (doc_id % 2 = 0) as kept from reviewed group by all) using (decision) group by decision
        union all
        select 'diagnostic', decision, count(distinct substr(squashed, 1, 220)), case decision when 'accept' then 1 else 2 end from rules group by decision)""",
    "stored_feedback": f"""
        select distinct 'rewrite' as kind, r.decision, {squash('p.from_text')} as a, {squash('p.to_text')} as b
        from ({_RESOLVED}) r join ({_COMMENT_PAIRS}) p on p.doc_id = r.doc_id and p.seq = r.seq where r.decision is not null
        union all select distinct 'diagnostic', decision, code, rtrim(substr({squash("regexp_extract(text, '(?s)^(?:[^]]*[]]){3}(.*)$', 1)")}, 1, 220)) from ({_RESOLVED}) where decision is not null""",
    "resolve_anchors": _ANCHORED,
    "section_hints": f"select doc_id, seq, unnest(range(len(h))) as nth, unnest(h) as hint from (select doc_id, seq, {hints('loc_section')} as h from v_diagnostics)",
    "comment_rows": f"""
        select a.doc_id, a.para_no, greatest(coalesce(m.max_id, 0), 0) + row_number() over (partition by a.doc_id order by a.seq) as comment_id, 'qa-bot' as author,
          '[' || case when d.code = 'LLM-NARR-001' then 'AI-REVIEW' else 'RULE-PATTERN' end || '][' || d.code || '][' || d.severity || '] ' || d.message as text
        from ({_ANCHORED}) a join v_diagnostics d on d.doc_id = a.doc_id and d.seq = a.seq
        left join (select doc_id, max(comment_id) as max_id from v_comments where author <> 'qa-bot' group by 1) m on m.doc_id = a.doc_id""",
    "narratives": _NARRATIVES,
    "packed_narratives": f"select doc_id, narrative, true as complete from ({_NARRATIVES})",
    "review_prompts": f"""
        select doc_id, 'Learned guidance:' || chr(10) || g.guidance || chr(10) || chr(10) || 'Rubric guidance:' || chr(10)
          || 'Judge layout, wording, tone, information and structure.' || chr(10) || chr(10) || 'Text to review:' || chr(10) || narrative as content
        from ({_NARRATIVES}) n, ({_GUIDE_PARTS}) g""",
    "llm_grounding": "select doc_id, nth, nth = 0 or contains(lower(text), lower(w2)) as grounded from v_messages",
    "llm_counts": f"""
        select doc_id, nth, message || case when n > 0 then ' Counts in narrative: "' || w || '"=' || n || 'x.' else '' end as message, n as max_count
        from (select *, {_MAX_COUNT} as n from v_messages)""",
    "llm_severity": f"""
        select doc_id, nth, case when nth = 1 then case when doc_id % 2 = 0 then 'warning' else 'error' end when {_WORD_COUNT} >= 6 then 'error' when {_WORD_COUNT} >= 3 then 'warning' else 'suggestion' end as severity
        from v_messages""",
    "llm_examples": f"""
        select doc_id, message || ' Example sentence: "' || case when length(s) > 220 then substr(s, 1, 217) || '...' else s end || '"' as message
        from (select doc_id, message, replace(sentence, chr(10), ' ') as s from ({support(_EXAMPLE_SOURCE)}))""",
    "llm_issues": f"""
        select doc_id, case when n >= 6 then 'error' else 'warning' end as severity, 'LLM-NARR-001' as code,
          'Avoid using ''' || w || ''' phrasing Counts in narrative: "' || w || '"=' || n || 'x.' as message, 'Narrative' as loc_section, 'ai_review' as source
        from (select doc_id, w, {count_of('lower(text)', 'w')} as n from ({_REVIEWED})) where n > 3
        union all
        select doc_id, 'suggestion', 'LLM-NARR-001', message || ' Example sentence: "' || case when length(s) > 220 then substr(s, 1, 217) || '...' else s end || '"', 'Narrative', 'ai_review'
        from (select doc_id, message, replace(sentence, chr(10), ' ') as s from (
          {support(f"select doc_id, text, 'Narrative' as hint, null as quote, 'Stating the obvious about ' || w as message from ({_REVIEWED})")}))
        union all
        select doc_id, 'warning', 'LLM-NARR-001', 'Use ''x'' instead of ''zzqq''', 'Narrative', 'ai_review' from ({_REVIEWED}) where contains(lower(text), 'zzqq')""",
    "llm_parse_failures": "select doc_id, 'warning' as severity, 'LLM-PARSE-001' as code, 'LLM returned non-JSON output for narrative review.' as message, 'Narrative' as loc_section from documents where doc_id % 5 = 4",
    "rubric_scores": """
        select doc_id, axis, case axis when 'look' then least(25, doc_id % 31) when 'structure' then 12 else 0 end as score,
          case axis when 'words' then 'Good' when 'structure' then 'Fair' when 'look' then case when doc_id % 31 >= 19 then 'Strong' when doc_id % 31 >= 10 then 'Fair' else 'Weak' end else 'Weak' end as rating
        from documents, (select unnest(['look', 'words', 'tone', 'information', 'structure']) as axis) where doc_id % 5 = 3""",
}

# --- the whole profile, and a scan with it ---------------------------------------------------------

_COUNTED = f"select kind, a as phrase, old, new from ({STATEMENTS['tracked_signals']}) where kind <> 'rewrite'"
_VOTED = f"""
    select pair_id, 0 as stage, 0 as para_no, seq, old_sentence as from_text, new_sentence as to_text, 1 as votes from ({_CHANGES})
    where kind = 'replaced' and {squash('old_sentence')} <> {squash('new_sentence')} and {high_signal('old_sentence', 'new_sentence')}
    union all select pair_id, stage, para_no, seq, from_text, to_text, 2
    from ({_TRACKED_PAIRS}) t join (select pair_id, 1 as stage, old_doc as doc_id from v_pairs union all select pair_id, 2, new_doc from v_pairs) r on r.doc_id = t.doc_id
    where from_text <> to_text"""
_LEARNED_REWRITES = f"""
    select arg_min(from_text, (pair_id, stage, para_no, seq)) as from_text, arg_min(to_text, (pair_id, stage, para_no, seq)) as to_text, cast(sum(votes) as bigint) as votes, 'versions' as source, '' as reason
    from ({_VOTED}) group by {squash('from_text')}, {squash('to_text')} having sum(votes) >= 2
    union all select a, b, votes, 'ai_compare', 'shorter' from ({STATEMENTS['ai_votes']}) where kind = 'rewrite'"""


def _ends(kind: str, column: str, shown: str) -> str:
    return " union all ".join(
        f"select '{kind}', {place}, 0, '{end}', {shown.format(end)}, null, null, samples from ({rank_values(column)})" for place, end in enumerate(("low", "median", "high"))
    )


_RULES = f"""
    select 'deprecated_' || kind as kind, new - old as o1, -old as o2, phrase, cast(new as varchar) as detail, null as source, null as reason, old as n
      from ({_COUNTED}) where old - new >= 4 and (kind = 'ngram' or length(phrase) >= 20)
    union all select 'case', 0, 0, lower, preferred, null, null, votes from ({_CASE})
    union all select 'rewrite', -votes, 0, from_text, to_text, source, reason, votes from ({_LEARNED_REWRITES})
    union all select 'ai_' || kind, -votes, 0, a, null, null, null, votes from ({STATEMENTS['ai_votes']}) where kind <> 'rewrite'
    union all select kind, -n, 0, value, cast(share as varchar), null, null, n from ({STATEMENTS['format_rules_styles']})
    union all select 'tracked', -n, 0, kind, null, null, null, n from (
      select case kind when 'del' then 'deleted' else 'inserted' end as kind, count(*) as n from v_tracked t join ({_ROLES}) r on r.doc_id = t.doc_id where trim(text) <> '' group by all
      union all select 'replacements', count(*) from ({_TRACKED_PAIRS}) t join ({_ROLES}) r on r.doc_id = t.doc_id)
    union all {_ends('image_width', 'width_emu', 'cast(cast({} as bigint) as varchar)')}
    union all {_ends('image_aspect', 'aspect', 'cast({} as varchar)')}"""
STATEMENTS["learned_profile"] = f"""
    select kind, row_number() over (partition by kind order by o1, o2, phrase, detail nulls first, source nulls first) as rank, phrase, detail, source, reason, cast(n as bigint) as n from ({_RULES})"""

_MERGED = f"""
    select arg_min(from_text, k) as from_text, arg_min(to_text, k) as to_text from (
      select *, (priority, -votes, from_text, to_text, source, reason) as k from (
        select from_text, to_text, 9999::bigint as votes, 0 as priority, 'accepted_feedback' as source, '' as reason from v_rewrite_rules
        union all select from_text, to_text, votes, 1, source, reason from ({_LEARNED_REWRITES})))
    where {squash('from_text')} <> '' and {squash('to_text')} <> '' group by {squash('from_text')}, {squash('to_text')}"""
_NOT_IGNORED = f"not (contains({squash('phrase')}, 'und') or contains('und', {squash('phrase')}))"
_WITH_RULES = [
    phrase_checks("DOC-STYLE-DEPRECATED-001", "Deprecated phrase found", f"select phrase, phrase as shown from ({_COUNTED}) where kind = 'ngram' and old - new >= 4 and {_NOT_IGNORED}"),
    phrase_checks("DOC-STYLE-DEPRECATED-AI-001", "AI-learned deprecated phrase found", f"select a as phrase, a as shown from (select a, a as phrase from ({STATEMENTS['ai_votes']}) where kind = 'phrase') where {_NOT_IGNORED}"),
    f"""select doc_id, 'suggestion' as severity, 'DOC-STYLE-CASE-001' as code, 'Preferred casing: "' || preferred || '"' as message
        from v_texts t, ({_CASE}) p where contains(lower(text), lower) and not contains(text, preferred)""",
    STATEMENTS["check_rewrites"].replace("from v_rewrite_rules where", f"from ({_MERGED}) where").replace("not (contains(a, 'und') or contains('und', a)) and ", ""),
    *[STATEMENTS[name] for name in ("check_paragraph_styles", "check_table_columns", "check_image_widths", "llm_issues", "llm_parse_failures")],
]
STATEMENTS["profile_scan"] = f"""
    select doc_id, severity, code, message from ({_SCAN})
    union all select doc_id, severity, code, message from ({' union all '.join(f"select doc_id, severity, code, message from ({x.replace('v_texts', 'v_secrets')})" for x in _WITH_RULES)}) d
    where {_SUPPRESSED}"""

# Columns that SQL would give a narrower integer type than the queries do.
BIGINT_COLUMNS = {
    "tracked_pairs": ["seq"],
    "config_rules": ["pos"],
    "section_depth": ["depth"],
    "phrase_counts": ["n"],
    "llm_payload": ["n_issues"],
    "report_versions": ["major"],
    "preferred_rewrites": ["priority"],
    "resolve_anchors": ["rung"],
    "llm_grounding": ["nth"],
    "llm_counts": ["nth", "max_count"],
    "llm_severity": ["nth"],
}


def _typed(name: str, sql: str) -> str:
    casts = ", ".join(f"cast({c} as bigint) as {c}" for c in BIGINT_COLUMNS.get(name, []))
    return f"select * replace ({casts}) from ({sql})" if casts else sql


ORACLES = {name: with_views(_typed(name, sql)) for name, sql in STATEMENTS.items()}
