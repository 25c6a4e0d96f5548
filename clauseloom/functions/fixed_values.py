"""The published rule set v1. Results depend on every character here."""

# --- Fixed values: whitespace as understood by the rules (not Java's or RE2's \s) -------------
WS = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NON_EOL = r"[^\n\r\x{2028}\x{2029}]"

# --- Fixed values: sentence delimiters --------------------------------------------------------
SENTENCE_MARKS = "。！？；!?;"

# --- Fixed values: requirement signals --------------------------------------------------------
HARD_ENGLISH = r"(?<![\p{L}\p{N}_])(?:must|shall)(?![\p{L}\p{N}_])"
HARD_CHINESE = r"必须|不得|应当|(?<!无)须(?!知)"
CHINESE_SCORE = (
    r"(?:最高可得|最高得|最高为|满分为|满分|分值为|分值|得|计|赋)"
    rf"{WS}*\d+(?:\.\d+)?{WS}*分(?![\p{{L}}\p{{N}}_])"
)
ENGLISH_PREFIX_SCORE = (
    r"(?<![\p{L}\p{N}_])(?:worth|award(?:ed)?|score(?:s)?|maximum|max)(?![\p{L}\p{N}_])"
    rf"(?:{WS}+of)?{WS}+\d+(?:\.\d+)?{WS}+points?(?![\p{{L}}\p{{N}}_])"
)
EXPLICIT_ENGLISH_SCORE = (
    rf"(?<![\p{{L}}\p{{N}}_])\d+(?:\.\d+)?{WS}+points?(?![\p{{L}}\p{{N}}_])"
)

# --- Fixed values: category vocabulary --------------------------------------------------------
COMPLIANCE_CHINESE = (
    "资格", "资质", "证书", "证照", "截止", "提交", "签字", "签章", "盖章", "密封", "废标", "无效", "合规",
)
COMMERCIAL_CHINESE = (
    "报价", "价格", "价款", "费用", "付款", "支付", "结算", "税", "保证金", "预算",
)
COMPLIANCE_ENGLISH = (
    r"(?:licen(?:se(?:s|d)?|sing)|certificat(?:e(?:s|d)?|ion(?:s)?)|deadlines?|submissions?"
    r"|signatures?|seal(?:s|ed|ing)?|compliance)"
)
COMMERCIAL_ENGLISH = (
    r"(?:prices?|pricing|payments?|costs?|fees?|invoices?|tax(?:es)?|deposits?|commercial)"
)

# --- Fixed values: heading grammar of plain text ----------------------------------------------
HEADING_MAX_UNITS = 120
TXT_MARKDOWN = rf"^(#{{1,6}})[\t ]+({NON_EOL}+)\z"
TXT_CHAPTER = rf"^第[零〇一二三四五六七八九十百千万两0-9]+([章节])[\t \x{{3000}}]*({NON_EOL}+)\z"
TXT_DECIMAL = rf"^(\d+(?:\.\d+)*)[\t \x{{3000}}]+({NON_EOL}+)\z"
TXT_CHINESE_LIST = rf"^[一二三四五六七八九十百]+、[\t \x{{3000}}]*({NON_EOL}+)\z"

# --- Fixed values: heading grammar of positioned page text -------------------------------------
PAGE_MARKDOWN = rf"^(#{{1,6}}){WS}+({NON_EOL}+)\z"
PAGE_CHAPTER = rf"^第[零〇一二三四五六七八九十百千万两0-9]+([章节]){WS}*({NON_EOL}+)\z"
PAGE_DECIMAL = rf"^(\d+(?:\.\d+)*)(?:[.)])?{WS}+({NON_EOL}+)\z"
PAGE_CHINESE_LIST = rf"^[一二三四五六七八九十百千万]+、{WS}*({NON_EOL}+)\z"
PAGE_TRAILING_MARK = rf"[。！？；!?;.]{WS}*\z"

# --- Fixed values: rule-set identity, codes and confidences ------------------------------------
PARSER_VERSION = "deterministic-rules-v1"
FIXTURE_METHOD = "development-fixture"
RULE_TASK_TYPE = "document-parse-v1"
FIXTURE_TASK_TYPE = "development-document-parse"
CONFIDENCE_BOTH, CONFIDENCE_HARD, CONFIDENCE_SCORE = "0.9800", "0.9500", "0.9000"

# --- Fixed values: development rows emitted per file -------------------------------------------
FIXTURE_ROWS = (
    ("DEV-001", "提交完整的技术实施方案", "开发演示数据：说明实施方法、项目计划、交付物与质量保障措施。", "technical", "mandatory"),
    ("DEV-002", "提供同类项目案例", "开发演示数据：列示代表性项目、服务范围和可核验的交付成果。", "commercial", "important"),
    ("DEV-003", "按时完成投标文件签章与提交", "开发演示数据：在截止时间前完成签章、校验与正式提交。", "compliance", "mandatory"),
)
FIXTURE_SECTION = "开发演示数据（非原文解析）"

# --- Fixed values: file formats ----------------------------------------------------------------
DOCX_MEDIA_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
FORMATS = (("txt", ".txt", "text/plain"), ("pdf", ".pdf", "application/pdf"), ("docx", ".docx", DOCX_MEDIA_TYPE))
MAX_UPLOAD_BYTES = 25 * 1024 * 1024

# --- Fixed values: per-document resource limits ------------------------------------------------
LIMITS = {
    "bytes": 25 * 1024 * 1024,
    "units": 10_000_000,
    "requirements": 2_000,
    "blocks": 100_000,
    "spans": 250_000,
    "pages": 1_000,
}

# --- Fixed values: permanent failure codes, transient error codes ------------------------------
FAILURE_CODES = (
    "FORMAT_MISMATCH", "UNSUPPORTED_DOCUMENT_FORMAT", "INVALID_PDF", "PDF_ENCRYPTED", "OCR_REQUIRED",
    "INVALID_DOCX", "DOCUMENT_RESOURCE_LIMIT_EXCEEDED", "DOCUMENT_PARSE_TIMEOUT",
    "INVALID_TEXT_ENCODING", "PARSER_WORKER_FAILED",
)
TRANSIENT_CODES = ("OBJECT_STORAGE_UNAVAILABLE", "DATABASE_UNAVAILABLE")
EXHAUSTED_CODE = "TASK_ATTEMPTS_EXHAUSTED"

# --- Fixed values: identifiers and date-times --------------------------------------------------
ULID = r"^[0-9A-HJKMNP-TV-Z]{26}$"
TENANT_ID = r"^[a-zA-Z0-9_-]{1,64}$"
SHA256_HEX = r"^[0-9a-f]{64}$"
RFC3339 = (
    r"^(\d{4})-(\d{2})-(\d{2})[Tt](\d{2}):(\d{2}):(\d{2})(\.\d+)?([Zz]|[+-](\d{2}):(\d{2}))$"
)
OBJECT_SUFFIX = r"^v[1-9][0-9]*/original$"

# --- Fixed values: locator keys ----------------------------------------------------------------
REAL_LOCATOR_KEYS = (
    "kind", "version", "sourceFileId", "sourceFileName", "sourceRevision", "sourceSha256", "quote",
    "quoteSha256", "textStart", "textEnd", "sectionPath", "parserVersion",
)
LOCATOR_KEYS = {
    "txt": REAL_LOCATOR_KEYS + ("start", "end"),
    "docx": REAL_LOCATOR_KEYS + ("ranges",),
    "pdf": REAL_LOCATOR_KEYS + ("regions",),
    "development-fixture": (
        "kind", "fileId", "fileName", "pageNumber", "sectionPath", "paragraphIndex", "quote",
    ),
}

# --- Fixed values: labels of the analyst screens -----------------------------------------------
UNMAPPED = "未映射"
UNCONFIRMED, TO_RESPOND, DRAFTING, REJECTED = "未确认", "待响应", "编写中", "已驳回"
TYPE_BY_CATEGORY = {"commercial": "商务要求", "compliance": "合规要求"}
DEFAULT_TYPE = "技术要求"
OPEN_ISSUE, CLOSED_ISSUE, BLOCKER = "待处理", "已解决", "阻断"
SECTION_APPROVED, SECTION_IN_REVIEW, SECTION_NOT_STARTED = "已批准", "待审核", "未开始"
PROJECT_STAGE = {"draft": "待上传", "active": "进行中", "archived": "已归档"}
LOW_CONFIDENCE = 85
CATEGORY_BY_EXTENSION = {"doc": "技术附件", "docx": "技术附件", "txt": "文本附件"}
PACKAGE_BY_EXTENSION = {"zip": "文件包", "xls": "评分附件", "xlsx": "评分附件"}
DEFAULT_FILE_CATEGORY = "招标正文"
PAGE_ANCHOR, LINE_ANCHOR, PARAGRAPH_INDEX, PARAGRAPH_ID = "第 %d 页", "第 %d 行", "段落索引 %d", "段落 %s"
NO_ANCHOR, REGION_DETAIL, RANGE_DETAIL = "未提供原文锚点", "区域 1：第 %d 页", "范围 1：%s · 字符 %d–%d"
TEXT_DETAIL, SECTION_DETAIL = "起点 %d:%d|终点 %d:%d（不含）", "章节：%s"
