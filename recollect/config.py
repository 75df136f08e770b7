"""Constants and weights; every function takes them as arguments with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

AS_OF = datetime(2024, 1, 31)

TYPES = ("working", "episodic", "semantic", "procedural")
SCOPES = ("private", "team", "public")
RELATIONS = ("cause_of", "derived_from", "duplicates", "contradicts")
EVENTS = ("used", "edited", "neglected", "helpful", "not_helpful")
SEVERITIES = ("low", "medium", "high", "critical")
CATEGORIES = ("database", "network", "validation", "authentication", "performance", "memory", "search", "embedding", "cache", "unknown")
METRICS = ("response_time", "memory_usage", "error_rate", "throughput", "database_performance", "cache_performance")
LEVELS = ("info", "warning", "critical")

HALF_LIFE_DAYS = {"working": 2, "episodic": 30, "semantic": 180, "procedural": 90}
OTHER_HALF_LIFE = 30
TYPE_BOOST = {"semantic": 0.1, "episodic": 0.0, "working": -0.05, "procedural": 0.05}
PINNED_BOOST = 0.2
TTL_SOFT_DAYS = {"working": 2, "episodic": 30, "semantic": 180, "procedural": 90}
TTL_HARD_DAYS = {"working": 7, "episodic": 180, "semantic": 365, "procedural": 180}
ERROR_LIMITS = {"low": 100, "medium": 50, "high": 10, "critical": 1}

#: Metric, level, threshold, operator, duration s, cooldown s.
THRESHOLDS = (
    ("response_time", "warning", 100.0, "gt", 30, 300),
    ("response_time", "critical", 500.0, "gt", 10, 60),
    ("memory_usage", "warning", 100.0, "gt", 60, 600),
    ("memory_usage", "critical", 200.0, "gt", 30, 300),
    ("error_rate", "warning", 5.0, "gt", 60, 300),
    ("error_rate", "critical", 10.0, "gt", 30, 180),
    ("throughput", "warning", 10.0, "lt", 60, 300),
    ("throughput", "critical", 5.0, "lt", 30, 180),
    ("database_performance", "warning", 50.0, "gt", 30, 300),
    ("database_performance", "critical", 100.0, "gt", 10, 180),
    ("cache_performance", "warning", 70.0, "lt", 60, 600),
    ("cache_performance", "critical", 50.0, "lt", 30, 300),
)

#: Metric kind, threshold, value from which it is critical.
MONITOR_RULES = (("memory", 80.0, 90.0), ("cpu", 70.0, 90.0), ("database", 100.0, 150.0), ("query", 1000.0, 2000.0))

#: Type, importance, privacy scope, days to live (None: no end).
TYPE_DEFAULTS = (("working", 0.3, "private", 2), ("episodic", 0.6, "private", 90), ("semantic", 0.8, "team", None), ("procedural", 0.7, "team", 180))

#: Parts of a tool's name and the category that the first of them gives.
TOOL_CATEGORIES = ((("memory", "remember", "recall"), "memory"), (("search", "find"), "search"), (("cleanup", "forget"), "maintenance"), (("performance", "monitor"), "monitoring"))

#: What no query may hold, whatever the case.
FORBIDDEN_IN_QUERIES = ("<script", "javascript:", "on[a-zA-Z0-9_]+[ \\t\\n\\r]*=")
LONGEST_QUERY = 1000

#: English stop words.
ENGLISH_STOP_WORDS = """the a an and or but in on at to for of with by from up about into through during before after above below
    down out off over under again further then once here there when where why how all any both each few more most
    other some such no nor not only own same so than too very can will just should now is are was were be been being
    have has had do does did would could may might must shall this that these those i you he she it we they me him her
    us them my your his its our their myself yourself himself herself itself ourselves yourselves themselves"""
#: Korean stop words.
KOREAN_STOP_WORDS = """이, 가, 을, 를, 에, 에서, 로, 으로, 와, 과, 도, 는, 은, 의, 에게, 한테, 부터, 까지, 만, 조차, 마저, 까지도, 조차도, 마저도,
    그, 저, 그것, 저것, 이것, 그들, 저들, 이들, 나, 너, 우리, 너희, 그녀, 자신, 자기, 본인, 당신, 여러분, 누구, 어느, 어떤, 무엇, 어디, 언제, 왜, 어떻게,
    하나, 둘, 셋, 넷, 다섯, 여섯, 일곱, 여덟, 아홉, 열, 첫째, 둘째, 셋째, 두, 세, 네,
    매우, 아주, 정말, 진짜, 너무, 완전, 정말로, 진짜로, 가장, 더, 더욱, 훨씬, 많이, 조금, 약간, 좀, 잘, 못, 안, 아니, 아닌, 아니야, 아니에요, 아닙니다,
    그냥, 그저, 단지, 이미, 벌써, 아직, 여전히, 다시, 또, 또다시, 바로, 곧, 즉시, 여기, 거기, 저기, 언제나, 항상, 어디서, 어디에,
    그리고, 그러나, 하지만, 그런데, 그래서, 따라서, 그러므로, 그러면, 그럼, 또한, 또는, 혹은, 아니면, 그러니까, 그러니,
    아, 어, 오, 우, 아이, 어이, 오이, 우이, 아하, 어라, 오호, 우와, 어머, 어머나, 아이고, 어이고, 오이고, 우이고,
    것, 거, 게, 수, 때, 때문, 때문에, 경우, 경우에, 상황, 상황에서, 문제, 문제가, 방법, 방법으로, 과정, 과정에서, 결과, 결과로, 이유, 이유로,
    목적, 목적으로, 의미, 의미로, 내용, 내용을, 형태, 형태로, 종류, 종류의, 부분, 부분을, 전체, 전체를, 일부, 일부를, 대부분, 대부분을, 모든, 모든 것을,
    각각, 각각의, 개별, 개별적으로, 공통, 공통으로, 특별, 특별히, 일반, 일반적으로, 보통, 보통으로, 평범, 평범하게, 특수, 특수하게,
    특별한, 일반적인, 보통의, 평범한, 특수한"""

STOP_WORDS = tuple(dict.fromkeys([*ENGLISH_STOP_WORDS.split(), *(w.strip() for w in KOREAN_STOP_WORDS.split(","))]))

#: Words that make a query technical.
TECHNICAL_QUERIES = "api|sql|http|json|xml|css|html|js|ts|react|vue|angular|node|python|java|c\\+\\+|go|rust|docker|kubernetes|aws|azure|gcp"
#: What makes a word technical, after lower-casing.
TECHNICAL_WORDS = "^[a-z]+_[a-z]+|api|sdk|http|json|xml|sql|db|ui|ux|ai|ml|nlp|react|vue|angular|node|python|java|typescript"


@dataclass(frozen=True)
class Preset:
    """What a kind of prompt asks for: types, days back (None: all), least importance and token budget."""

    kind: str
    types: tuple[str, ...] | None
    recent_days: int | None
    importance_min: float
    budget: int


#: Fixed values.
PRESETS = {
    "conversation": Preset("conversation", ("episodic", "semantic"), 30, 0.4, 1000),
    "task": Preset("task", ("procedural", "semantic"), None, 0.5, 1200),
    "learning": Preset("general", ("semantic", "procedural"), None, 0.6, 1500),
    "project": Preset("task", None, None, 0.0, 1000),
}


@dataclass(frozen=True)
class Settings:
    """What a deployment sets; from_env reads it from variables of these names in capitals."""

    server_name: str = "memory"
    server_version: str = "0.1.0"
    port: int = 3000
    embedding_provider: str = "lightweight"
    embedding_api_key: str | None = None
    embedding_dimensions: int = 512
    search_default_limit: int = 10
    search_max_limit: int = 50
    forget_working_ttl: int = 48
    forget_episodic_ttl: int = 2160
    forget_semantic_ttl: int = -1
    forget_procedural_ttl: int = -1
    log_level: str = "info"
    log_file: str | None = None
    environment: str = "development"

    @classmethod
    def from_env(cls, env) -> "Settings":
        """Whole numbers where the default is one; a variable that is empty counts as not set."""
        given = {f.name: env[f.name.upper()] for f in fields(cls) if env.get(f.name.upper())}
        return cls(**{k: int(v) if isinstance(getattr(cls, k), int) else v for k, v in given.items()})

    def ttl_hours(self) -> dict[str, int | None]:
        """How long memories of each type live; None: no end."""
        return {t: None if (h := getattr(self, f"forget_{t}_ttl")) < 0 else h for t in TYPES}

    def model_info(self) -> dict:
        """model, dimensions, max_tokens and whether it can be used: the light model always, another with a key."""
        light = self.embedding_provider == "lightweight"
        return {"model": "lightweight-hybrid" if light else self.embedding_provider, "dimensions": self.embedding_dimensions, "max_tokens": 8191, "available": light or bool(self.embedding_api_key)}

    def errors(self) -> list[str]:
        out = []
        if self.embedding_provider != "lightweight" and not self.embedding_api_key:
            out.append(f"embedding_api_key is required for {self.embedding_provider}")
        if self.embedding_dimensions <= 0:
            out.append("embedding_dimensions is not positive")
        if self.search_default_limit <= 0 or self.search_max_limit <= 0:
            out.append("a search limit is not positive")
        elif self.search_default_limit > self.search_max_limit:
            out.append("search_default_limit is above search_max_limit")
        return out


def search_errors(query, limit=None, filters=None) -> list[str]:
    """What is wrong with a search's parameters as a caller gives them: filters as a dict of lists and values."""
    out = []
    if not query or not isinstance(query, str):
        out.append("query is not a text")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, (int, float)) or limit < 0):
        out.append("limit is not a number from 0")
    for name in ("type", "tags"):
        if (filters or {}).get(name) and not isinstance(filters[name], (list, tuple)):
            out.append(f"filters.{name} is not a list")
    return out


@dataclass(frozen=True)
class RankWeights:
    relevance: float = 0.5
    recency: float = 0.2
    importance: float = 0.2
    usage: float = 0.1
    duplication: float = 0.15


@dataclass(frozen=True)
class ForgetWeights:
    recency: float = 0.35
    usage: float = 0.25
    duplication: float = 0.2
    importance: float = 0.15
    pinned: float = 0.3


@dataclass(frozen=True)
class ReviewWeights:
    importance: float = 0.6
    usage: float = 0.4
    helpful: float = 0.5
    bad: float = 0.7


@dataclass(frozen=True)
class Filters:
    """Search filters; None does not filter. All are applied before any candidate is cut."""

    ids: tuple[str, ...] | None = None
    types: tuple[str, ...] | None = None
    scopes: tuple[str, ...] | None = None
    pinned: bool | None = None
    time_from: datetime | None = None
    time_to: datetime | None = None
    tags: tuple[str, ...] | None = None
    importance_min: float | None = None
    importance_max: float | None = None
    project: str | None = None

    def applied(self) -> dict:
        """The filters that are set, by name."""
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}

    def errors(self) -> list[str]:
        out = []
        if self.time_from and self.time_to and self.time_from > self.time_to:
            out.append("time_from is after time_to")
        if self.importance_min is not None and self.importance_max is not None and self.importance_min > self.importance_max:
            out.append("importance_min is above importance_max")
        return out
