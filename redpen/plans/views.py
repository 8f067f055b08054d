"""Report-shaped tables derived from the generic test tables, for queries and tests.

Every view is defined over whole tables.  Values vary by arithmetic on ids; no rows
are left out by it.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from redpen.operators import structure
from redpen.operators.ordered import numbered, position_bucket
from redpen.operators.structure import STRETCH_LINES

COLUMNS = {
    "documents": ["doc_id", "text", "lang", "source"],
    "orders": ["o_orderkey", "o_custkey", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"],
    "part": ["p_partkey", "p_brand"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The columns used of one table, read as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*COLUMNS[name])


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table that lies in fewer files than there are cores, dealt to all of them; others as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores, key)


class Views:
    """The derived tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        rows = table(self.spark, self.sf_dir, name)
        return spread(rows, "doc_id") if name == "documents" else rows

    def _sql(self, statement: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(statement, **frames)

    def paras(self) -> DataFrame:
        return self._sql(
            """select doc_id, pos as para_no, trim(t) as text
               from {d} lateral view posexplode(split(text, chr(10), -1)) x as pos, t where trim(t) <> ''""",
            d=self.raw("documents"),
        )

    def texts(self) -> DataFrame:
        """Non-blank lines joined again, one row per document."""
        # not F.trim by itself: transform would hand it a line's place as the characters to take off
        lines = F.filter(F.transform(F.split("text", "\n"), lambda p: F.trim(p)), lambda p: p != "")
        return self.raw("documents").select("doc_id", F.array_join(lines, "\n").alias("text"))

    def blocks(self) -> DataFrame:
        return self._sql(
            """select doc_id, para_no as block_no, 'p' as type,
                 case when doc_id % 10 = 3 and para_no = 1 then 'List of Figures' else text end as text,
                 case when para_no % 6 = 0 then 'S' || cast(para_no % 4 as string) end as style_id,
                 case when para_no % 6 = 0 then 'heading ' || cast(1 + cast(floor(para_no / 6.0) as int) % 3 as string) else 'Normal' end as style_name,
                 case when para_no % 6 = 0 then 1 + cast(floor(para_no / 6.0) as int) % 3 end as heading_level,
                 cast(null as array<array<string>>) as rows
               from {p}""",
            p=self.paras(),
        )

    def deep_blocks(self) -> DataFrame:
        """Every second paragraph a heading of one of 40 levels."""
        return self._sql(
            """select doc_id, para_no as block_no, 'p' as type, text,
                 case when para_no % 2 = 1 then 1 + cast((para_no * para_no * 7 + doc_id) % 40 as int) end as heading_level from {p}""",
            p=self.paras(),
        )

    def breaks(self) -> DataFrame:
        return self._sql(
            """select doc_id, para_no, (doc_id + para_no) % 5 in (0, 1) as has_break,
                 case when (doc_id + para_no) % 3 = 0 then '' else text end as text from {p}""",
            p=self.paras(),
        )

    def findings(self) -> DataFrame:
        return self._sql(
            """select o_custkey as doc_id, o_orderkey as finding_no, 'Finding ' || cast(o_orderkey as string) as title,
                 case substr(o_orderpriority, 1, 1) when '1' then 'Critical' when '2' then 'High' when '3' then 'Medium'
                   when '5' then 'Low' else 'Informational' end as threat_text,
                 case o_orderkey % 3 when 0 then s || ' CVSS:4.0/AV:N' when 1 then 'CVSS: ' || s else 'score ' || s end as cvss_text
               from (select *, cast(cast(floor((o_orderkey % 100) / 10.0) as int) as string) || '.' || cast(o_orderkey % 10 as string) as s from {o})""",
            o=self.raw("orders"),
        )

    def finding_stretches(self) -> DataFrame:
        """The paragraphs of one document for each finding, with labels and captions, as ``structure.stretches``."""
        documents = self.raw("documents").agg(F.count("*").alias("n")).select("n").scalar()
        findings = self.findings().select("doc_id", "finding_no", (F.col("finding_no") % documents).alias("from_doc"))
        split, stretch = F.split("text", "\n", -1), F.floor(F.col("last") / STRETCH_LINES)
        paras = F.filter(F.transform(split, lambda p, i: F.struct(i.alias("para_no"), F.trim(p).alias("text"))), lambda p: p["text"] != "")
        whole = self.raw("documents").select("doc_id", (F.size(split) <= STRETCH_LINES).alias("alone"), (F.size(split) - 1).alias("last"), paras.alias("paras"))
        long = whole.filter("not alone").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), stretch)).alias("stretch"))
        parts = long.withColumn("paras", F.filter("paras", lambda p: F.floor(p["para_no"] / STRETCH_LINES) == F.col("stretch")))
        cut = whole.filter("alone").withColumn("stretch", F.lit(0).cast("bigint")).unionByName(parts).filter("size(paras) > 0")
        return self._sql(
            """select f.doc_id, f.finding_no, p.stretch, p.alone, transform(p.paras, p -> named_struct('line_no', p.para_no, 'line',
                 case when p.para_no % 4 = 0 then coalesce(get(array('Narrative:', 'Business Impact:', 'Recommendation:', 'Evidence:', 'Steps to Reproduce:', 'Notes:'),
                     cast((f.finding_no + p.para_no div 4) % 7 as int)), 'Description: ')
                   when p.para_no % 9 = 5 then 'Figure ' || cast(p.para_no as string) || ' ' || p.text else p.text end)) as lines
               from {f} f join {p} p on p.doc_id = f.from_doc""",
            f=findings, p=cut,
        )

    def finding_lines(self) -> DataFrame:
        return structure.long_lines(self.finding_stretches())

    def finding_blocks(self) -> DataFrame:
        return self._sql(
            """select doc_id, finding_no * 1000000 as block_no, 'p' as type, title as text, cast(null as array<array<string>>) as rows from {f}
               union all
               select doc_id, finding_no * 1000000 + 1, 'tbl', cast(null as string), array(array('Threat Level', threat_text, 'CVSS', cvss_text)) from {f}
               union all
               select doc_id, finding_no * 1000000 + 2 + line_no, 'p', line, cast(null as array<array<string>>) from {l}""",
            f=self.findings(), l=self.finding_lines(),
        )

    def finding_block_stretches(self) -> DataFrame:
        """``finding_blocks`` as stretches: a finding's title and table in one row, its lines as they come."""
        return self._sql(
            """select doc_id, array(
                 named_struct('block_no', finding_no * 1000000, 'type', 'p', 'text', title, 'rows', cast(null as array<array<string>>)),
                 named_struct('block_no', finding_no * 1000000 + 1, 'type', 'tbl', 'text', cast(null as string), 'rows', array(array('Threat Level', threat_text, 'CVSS', cvss_text)))) as blocks
               from {f}
               union all
               select doc_id, transform(lines, l -> named_struct('block_no', finding_no * 1000000 + 2 + l.line_no, 'type', 'p', 'text', l.line, 'rows', cast(null as array<array<string>>))) from {s}""",
            f=self.findings(), s=self.finding_stretches(),
        )

    def versions(self) -> DataFrame:
        """Families of near copies, numbered; a family may hold a large share of all documents."""
        keyed = self.raw("documents").select("doc_id", F.lower(F.substring("text", 1, 60)).alias("start"))
        family = keyed.groupBy("start").agg(F.min("doc_id").alias("family"))
        members = keyed.join(family, "start").select("doc_id", "family")
        placed = numbered(members, ["family"], ["doc_id"], position_bucket("doc_id"), "version")
        return placed.withColumn("file_name", F.format_string("Report %d_v0.%d.docx", "family", "version"))

    def versions_case(self) -> DataFrame:
        return self._sql(
            """select v.doc_id, v.family, v.version, p.para_no,
                 case when v.version % 2 = 1 and p.para_no % 7 = 0 then lower(p.text) else p.text end as text
               from {v} v join {p} p on p.doc_id = v.doc_id""",
            v=self.versions(), p=self.paras(),
        )

    def layout(self) -> DataFrame:
        return self._sql(
            """select l_suppkey as doc_id,
                 case when l_partkey % 10 < 8 then 'S' || cast(l_partkey % 4 as string) else p_brand end as style_id,
                 case when l_linenumber % 2 = 0 then 'both' else 'default' end as alignment,
                 case when l_linenumber <= 5 then l_linenumber % 2 + 2 else l_linenumber end as columns,
                 cast(floor(l_extendedprice) as bigint) as width_emu, cast(floor(l_quantity * 1000) as bigint) as height_emu
               from {l} join {p} on l_partkey = p_partkey""",
            l=self.raw("lineitem"), p=self.raw("part"),
        )

    def comments(self) -> DataFrame:
        return self._sql(
            r"""select conv_id as doc_id, turn as seq, turn as comment_id,
                 case when role = 'assistant' then 'qa-bot' else 'reviewer' end as author,
                 case when role <> 'assistant' and conv_id % 2 = 0 and turn > 0 then turn - 1 end as parent_id,
                 case when role = 'assistant' then '[RULE-PATTERN][DOC-STYLE-REWRITE-001][suggestion] Preferred rewrite: "'
                     || substr(replace(text, '"', ''), 1, 30) || '" -> "' || substr(replace(text, '"', ''), 1, 20) || '"'
                   else case conv_id % 5 when 0 then '[ACCEPT] ' when 1 then 'rejected' when 2 then 'Reject: ' when 3 then '[ Rejected ] ' else '' end
                     || case when conv_id % 5 = 1 then '' else substr(text, 1, 20) end end as text
               from {c}""",
            c=self.raw("conversations"),
        )

    def responses(self) -> DataFrame:
        """Model answers: an array, fenced, in prose, an object with scores, and none."""
        return self._sql(
            """select doc_id, case doc_id % 5 when 0 then body when 1 then 'Here: ```json ' || body || ' ```' when 2 then 'Result: ' || body || ' end'
                 when 3 then '{{"issues":' || body || ',"rubric_scores":{{"look":{{"score":"' || cast(doc_id % 31 as string) || '"}},"words":{{"score":-1,"rating":" Good "}},"tone":{{"score":"x"}},"structure":{{"score":12}}}}}}'
                 else 'no issues found' end as response
               from (select doc_id, '[{{"severity":"suggestion","message":"Avoid using ' || chr(39) || w || chr(39)
                   || ' phrasing","location_hint":"Narrative"}},{{"severity":"warning","message":"Use ' || chr(39) || 'x' || chr(39) || ' instead of ' || chr(39) || 'zzqq' || chr(39)
                   || '"}},{{"message":"Stating the obvious about ' || w || '"}}]' as body
                 from (select doc_id, case lang when 'en' then 'the' when 'fr' then 'les' when 'de' then 'und' else 'que' end as w from {d}))""",
            d=self.raw("documents"),
        )

    def secrets(self) -> DataFrame:
        return self._sql(
            """select doc_id, text || chr(10) || case doc_id % 7 when 0 then 'key AKIA' || 'ABCDEFGHIJKLMNOP end' when 1 then 'Bearer abc.def-123= tail'
                 when 2 then 'password: hunter22' when 3 then '-----BEGIN ' || 'RSA PRIVATE KEY-----' when 4 then 'eyJ' || 'abcdefghij12.abcdefghij12.abcdefghij12'
                 when 5 then 'see https://example.org/a and 10.0.0.1' else 'critical  high' end as text
               from {d}""",
            d=self.raw("documents"),
        )

    def phrases(self) -> DataFrame:
        return self.spark.sql(
            "select * from values ('the objective was'), ('of the'), ('les'), ('the'), ('und') as t(phrase)"
        )

    def tracked(self) -> DataFrame:
        """Per paragraph one deletion and up to two insertions, some of them empty."""
        return self._sql(
            """select doc_id, para_no, stack(3,
                   0, 'del', substr(text, 1, 60),
                   1, 'ins', case when doc_id % 3 <> 0 then 'Revised ' || substr(text, 1, 40) else ' ' end,
                   2, 'ins', case when doc_id % 4 = 0 then 'Added ' || cast(doc_id as string) else '' end) as (seq, kind, text)
               from {p}""",
            p=self.paras(),
        )

    def pair_responses(self) -> DataFrame:
        """A model's reading of each version after the first; one family in five has none."""
        return self._sql(
            """select 'p' || cast(family as string) || '_' || cast(version as string) as pair_id,
                 case when family % 5 = 4 then 'none' else '{{"deprecated_phrases":["Of The","' || lang || '"],"preferred_rewrites":[{{"from":"the tested device unit","to":"the tested unit","reason":"shorter"}}],"style_rules":["Use active voice."]}}' end as response
               from (select v.family, v.version, d.lang from {v} v join {d} d on d.doc_id = v.doc_id where v.version > 1)""",
            v=self.versions(), d=self.raw("documents"),
        )

    def rewrite_rules(self) -> DataFrame:
        return self._sql(
            "select distinct substr(text, 1, 40) as from_text, substr(text, 1, 30) || ' revised' as to_text from {p}", p=self.paras()
        )

    def diagnostics(self) -> DataFrame:
        return self._sql(
            r"""select doc_id, para_no as seq, case para_no % 3 when 0 then 'suggestion' when 1 then 'warning' else 'error' end as severity,
                 case para_no % 4 when 0 then 'DOC-STYLE-HYGIENE-001' when 1 then 'DOC-SENS-001' when 2 then 'LLM-NARR-001' else 'DOC-STYLE-REWRITE-001' end as code,
                 'Check "' || substr(replace(text, '"', ''), 1, 25) || '" and the tone' as message,
                 case when para_no % 4 = 2 then substr(text, 1, 12) || ' and Scope section' else 'Document' end as loc_section,
                 case when para_no % 4 = 0 then substr(text, 5, 30) end as loc_text,
                 cast(null as string) as loc_finding, cast(null as string) as source
               from {p}""",
            p=self.paras(),
        )

    def diagnostic_rules(self) -> DataFrame:
        return self.spark.sql(
            """select * from values ('accept', 'DOC-SENS-001', 'check "'), ('reject', 'DOC-SENS-001', ''), ('reject', 'LLM-NARR-001', 'the tone'),
               ('ignore', 'DOC-STYLE-REWRITE-001', ''), ('ignore', '', 'check "the') as t(decision, code, message_contains)"""
        )

    def configs(self) -> DataFrame:
        """One rule file per document, with blank and ill-typed items in it."""
        return self._sql(
            """select doc_id, '{{"ignore_deprecated_phrases":["' || lang || '"," ",7],"ignore_diagnostic_codes":"none","accepted_rewrites":[{{"from":" ' || lang
                 || ' ","to":"' || source || '"}},{{"from":"x","to":""}},"bad"],"rejected_diagnostics":[{{"code":"C' || cast(doc_id as string) || '"}},{{"code":""}}]}}' as json
               from {d}""",
            d=self.raw("documents"),
        )

    def packages(self) -> DataFrame:
        """Every document as a report package, like rows of the ``binaryFile`` source."""
        return self.raw("documents").select("doc_id", "text").mapInArrow(_pack, "doc_id bigint, content binary")


#: Characters of text that are packed at a time.
PACK_CHARS = 1 << 20


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A paragraph per line, some with styles, alignment, page breaks, tracked changes or images; a table grid and a comment."""
    names = "".join(
        f'<w:style w:styleId="H{n}"><w:name w:val="heading {n}"/></w:style>' for n in (1, 2, 3)
    )
    main = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    drawing = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
    space = f'xmlns:w="{main}" xmlns:wp="{drawing}"'

    def paragraph(number: int, line: str) -> str:
        style = f'<w:pStyle w:val="H{1 + number // 6 % 3}"/>' if number % 6 == 0 else ""
        align = '<w:jc w:val="both"/>' if number % 3 == 0 else ""
        more = '<w:r><w:br w:type="page"/></w:r>' if number % 5 == 4 else ""
        if number % 7 == 3:
            more += f"<w:del><w:r><w:delText>gone {number}</w:delText></w:r></w:del><w:ins><w:r><w:t> </w:t></w:r></w:ins>"
        if number % 11 == 5:
            more += f'<w:r><w:drawing><wp:inline><wp:extent cx="{1000 * (number + 1)}" cy="500"/></wp:inline></w:drawing></w:r>'
        return f'<w:p><w:pPr>{style}{align}</w:pPr><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r>{more}</w:p>'

    def pack(text: str) -> bytes:
        lines = text.split("\n")
        body = "".join(paragraph(i, line) for i, line in enumerate(lines))
        grid = f"<w:tbl><w:tblGrid>{'<w:gridCol/>' * (2 + len(lines) % 3)}</w:tblGrid></w:tbl>"
        comment = f'<w:comment w:id="{len(lines)}" w:author=" lead "><w:p><w:r><w:t>ACCEPT {len(lines)} lines</w:t></w:r></w:p></w:comment>'
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
            package.writestr("word/document.xml", f"<w:document {space}><w:body>{body}{grid}</w:body></w:document>")
            package.writestr("word/styles.xml", f"<w:styles {space}>{names}</w:styles>")
            package.writestr("word/comments.xml", f"<w:comments {space}>{comment}</w:comments>")
        return out.getvalue()

    for batch in batches:
        ids, contents, chars = [], [], 0
        for doc_id, text in zip(*batch.columns, strict=True):
            body = text.as_py()
            ids.append(doc_id.as_py())
            contents.append(pack(body))
            chars += len(body)
            if chars >= PACK_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.binary())], ["doc_id", "content"])
                ids, contents, chars = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.binary())], ["doc_id", "content"])
