"""Every threshold, weight and switch of an audit, as one typed value."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

# --- fixed values: default weights
DEFAULT_PENALTIES = {
    "redirect": 5, "redirect_chain_long": 8, "redirect_offsite": 5,
    "link_missing": 30, "nofollow": 10, "sponsored": 8, "ugc": 6,
    "hidden_link": 15, "sitewide_link": 12,
    "noindex": 25, "page_nofollow": 10, "robots_blocked": 15,
    "thin_content": 8, "outbound_high": 10, "outbound_extreme": 20,
    "paid_link_marker": 8, "link_directory": 12, "irrelevant": 5,
    "spam_score_mid": 15, "spam_score_high": 30,
    "bad_neighbourhood": 35, "topical_mention": 10,
    "non_https": 3, "tls_invalid": 12, "no_https": 6,
    "homepage_spam": 40, "homepage_dead": 15, "homepage_parked": 50,
    "lang_mismatch": 10, "free_subdomain": 12, "spam_tld": 6,
    "network": 12,
}
DEFAULT_TIER_BASE = {"A": 92, "B": 86, "C": 70, "D": 58}
DEFAULT_CAPS = {
    "DEAD": 5, "GONE": 5, "DNS_ERROR": 3, "SSL_ERROR": 40, "ERROR": 15,
    "SERVER_ERROR": 30, "BLOCKED": 45, "RATE_LIMITED": 45,
}


@dataclass(frozen=True)
class AuditConfig:
    # whose links are audited
    target_site: str = ""
    target_aliases: tuple[str, ...] = ()
    # scoring
    tier_base: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_TIER_BASE))
    da_weight: float = 0.5
    good: float = 75
    review: float = 50
    penalties: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_PENALTIES))
    caps: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_CAPS))
    parked_cap: float = 8
    network_evidence_size: int = 5
    # staged gates
    staged: bool = True
    metrics_only_for_passing: bool = True
    noindex_fails_gate: bool = True
    render_blocked: bool = True
    sitewide_sample: int = 3
    # content
    min_word_count: int = 150
    outbound_warn: int = 150
    outbound_bad: int = 300
    content_total_hits: int = 4
    content_category_hits: int = 3
    expected_languages: tuple[str, ...] = ("en",)
    relevance_keywords: tuple[str, ...] = ()
    relevance_synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    # link networks
    min_cluster: int = 3
    # anchors
    brand_terms: tuple[str, ...] = ()
    max_single_anchor_share: float = 25
    max_keyword_share: float = 50
    max_image_share: float = 40
    # metrics and history
    reuse_metrics_days: float = 30
    cache_days: float = 30
    resume_hours: float = 24
    # host pacing
    delay_per_host: float = 1.0
    max_delay_per_host: float = 15.0
    backoff_recover: float = 0.85

    def brands(self) -> list[str]:
        """Brand terms, or the first label of the target site when none are given."""
        terms = [b.lower().strip() for b in self.brand_terms if b.strip()]
        stem = self.target_site.replace("www.", "").split(".")[0].lower()
        return terms or ([stem] if stem else [])

    def with_changes(self, **changes: Any) -> "AuditConfig":
        return replace(self, **changes)

    @classmethod
    def from_mapping(cls, raw: dict[str, Any]) -> "AuditConfig":
        """Read a nested settings mapping (as loaded from YAML)."""
        scoring, content = raw.get("scoring") or {}, raw.get("content") or {}
        gates, network = raw.get("pipeline") or {}, raw.get("network") or {}
        found = raw.get("network_footprint") or {}
        anchors, store = raw.get("anchors") or {}, raw.get("database") or {}
        limits, metrics = scoring.get("thresholds") or {}, raw.get("metrics") or {}
        values: dict[str, Any] = {
            "target_site": raw.get("target_site"),
            "da_weight": scoring.get("da_weight"),
            "good": limits.get("good"), "review": limits.get("review"),
            "min_cluster": found.get("min_cluster"),
            "max_single_anchor_share": anchors.get("max_single_anchor_share"),
            "max_keyword_share": anchors.get("max_keyword_share"),
            "reuse_metrics_days": store.get("reuse_metrics_days"),
            "cache_days": metrics.get("cache_days"),
            "delay_per_host": network.get("delay_per_host"),
            "max_delay_per_host": network.get("max_delay_per_host"),
            "backoff_recover": network.get("backoff_recover"),
        }
        for key in ("staged", "metrics_only_for_passing", "noindex_fails_gate",
                    "render_blocked", "sitewide_sample", "resume_hours"):
            values[key] = gates.get(key)
        for key in ("min_word_count", "outbound_warn", "outbound_bad"):
            values[key] = content.get(key)
        for key, source in (("target_aliases", raw.get("target_aliases")),
                            ("expected_languages", content.get("expected_languages")),
                            ("relevance_keywords", content.get("relevance_keywords")),
                            ("brand_terms", anchors.get("brand_terms"))):
            values[key] = tuple(str(x) for x in source) if source is not None else None
        synonyms = content.get("relevance_synonyms")
        if synonyms is not None:
            values["relevance_synonyms"] = {k: tuple(v or ()) for k, v in synonyms.items()}
        penalties = dict(DEFAULT_PENALTIES)
        penalties.update(scoring.get("penalties") or {})
        if "penalty_per_cluster" in found:
            penalties["network"] = found["penalty_per_cluster"]
        values["penalties"] = penalties
        values["tier_base"] = {**DEFAULT_TIER_BASE, **(scoring.get("tier_base") or {})}
        return cls(**{k: v for k, v in values.items() if v is not None})

    @classmethod
    def from_yaml(cls, path: str) -> "AuditConfig":
        import yaml

        with open(path, encoding="utf-8") as handle:
            return cls.from_mapping(yaml.safe_load(handle) or {})
