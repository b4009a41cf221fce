"""Source registry, vocabularies and fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SourceSpec:
    """A source of daily CSV drops: where its files lie and under which headers its fields come."""

    name: str
    kind: str
    subdir: str
    patterns: tuple[str, ...]
    title: tuple[str, ...]
    body: tuple[str, ...]
    authors: tuple[str, ...]
    url: tuple[str, ...]


#: Folders, file names and header aliases, in order of preference. The names are this registry's own.
SOURCES = (
    SourceSpec("daily-news", "news", "csv", (r"^\d{4}-\d{2}-\d{2}\.csv$",), ("标题", "title"), ("正文", "content", "summary", "摘要"), ("作者", "author"), ("URL", "url", "link")),
    SourceSpec("articles", "news", "data", (r"^articles-\d{4}-\d{2}-\d{2}\.csv$",), ("title", "标题"), ("content", "正文", "summary", "摘要"), ("author", "作者"), ("url", "URL", "link")),
    SourceSpec("abstracts", "literature", "output", (r"^news_with_abstract_\d{4}-\d{2}-\d{2}\.csv$",), ("title", "标题"), ("abstract", "summary", "摘要", "content"), ("author", "authors", "作者"), ("url", "URL", "link")),
)


@dataclass(frozen=True)
class Leaf:
    """A taxonomy leaf; its name is its path joined by dashes, else its label."""

    path: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    label: str | None = None

    @property
    def name(self) -> str:
        return "-".join(self.path) or (UNCLASSIFIED if self.label is None else self.label)


#: Terms whose presence in title or body flags a record.
ALERT_TERMS = ("突破", "首个", "量产", "商业化", "刷新", "record", "first", "pilot", "commercial")

#: Units in the order in which they are tried.
UNITS = ("%", "nm", "mm", "cm", "m", "kg", "g", "t", "w", "kw", "mw", "gw", "kwh", "mwh", "gwh", "v", "kv", "mah", "wh", "℃", "°c", "k", "ms", "s", "h", "d", "倍", "x", "亿元", "万元", "美元")

#: Labels and defaults.
UNCLASSIFIED = "未分类"
UNRELATED = "不相关"
NO_UNIT = "无单位"
NO_DATE = "未知日期"
NO_TITLE = "未命名情报"
NO_BODY = "无正文摘要"
NEWS_LABEL = "新闻"
LITERATURE_LABEL = "文献"
PARAM_REASON = "数值+单位"
DEFAULT_REASON = "default_unclassified_until_gpt54mini_review"
MISSING_REASON = "missing from model output"
BOTTLENECK = "需在后续 LLM 生成阶段补充卡点技术。"
PROFILE = "该行业当前收录 %d 条情报，其中新闻 %d 条，文献 %d 条。"
GROUP_ORDER = ("零碳产业", "AI与智能科技", "通用技术", UNRELATED, UNCLASSIFIED)
TRUSTED_MODELS = ("glm-5.2", "gpt-5.4-mini")
CHIP_LABELS = {"query": "检索", "date": "日期", "category": "分类", "type": "类型", "alert": "预警"}
ALERT_LABELS = {"yes": "预警", "no": "非预警"}

#: Page sizes, limits and cuts of texts.
PAGE_SIZE = 40
SNAPSHOT_ROWS = 500
EVIDENCE_ROWS = 30
FRONTIER_VALUES = 12
EVIDENCE_PARAMS = 5
KEY_METRICS = 8
PARAMS_PER_RECORD = 8
EVIDENCE_CHARS = 220
REQUEST_CHARS = 800
SINGLE_REQUEST_CHARS = 900
SUMMARY_CHARS = 300
TARGET_ROWS = 38121

#: What begins the reason of a record whose answer never came in form, and how much of the answer follows.
FAILURES = {"batch": ("LLM batch parse failed: ", 120), "date": ("LLM batch output parse failed: ", 160), "single": ("LLM output parse failed: ", 180)}
#: Workers, batches after which answers are kept, and seconds that a call may take, alone or for a batch.
WORKERS = 6
FLUSH_BATCHES = 50
SECONDS = {"batch": 300.0, "date": 300.0, "single": 90.0}

#: The classification job's constant parts.
JOB_EXTRACTOR = "v4-classification-batch"
JOB_PHASES = {"phase_1": "keyword_and_taxonomy_candidates", "phase_2": "small_model_choice_within_candidates", "phase_3": "low_confidence_review_only"}
JOB_CACHE_KEY = ("url", "content_hash", "taxonomy_version", "extractor_version")
JOB_RULES = (
    "Prefer 零碳产业 and AI与智能科技 over 通用技术 when applicable.",
    "Use 不相关 for records outside the tracked technology boundary.",
)
JOB_NOTES = ("Do not classify full text freely.", "Prefer candidate-restricted classification.", "Keep audit trail for every decision.")

#: Keys of the meta document, in order, and its defaults.
META_KEYS = ("records_total", "records_by_type", "source_files", "taxonomy_version", "extractor_version", "processed_at", "warnings")
EXTRACTOR = "v3-sharded"
UNKNOWN = "unknown"
