"""Settings: thresholds, quotas, lookup maps and column maps, with overrides from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

# Fixed values from here to OUTLETS: what a switching user's data and results depend on.
NUANCE_BLOCS: dict[str, str] = {
    "SOC": "gauche", "DVG": "gauche", "RDG": "gauche", "COM": "gauche", "ECO": "gauche", "VEC": "gauche", "NUA": "gauche", "FI": "gauche", "EXG": "gauche", "UG": "gauche",
    "REN": "centre", "MDM": "centre", "UDI": "centre", "UVC": "centre", "HOR": "centre", "UC": "centre",
    "LR": "droite", "DVD": "droite", "DSV": "droite", "UD": "droite", "UDR": "droite",
    "RN": "extreme_droite", "UXD": "extreme_droite", "EXD": "extreme_droite", "REC": "extreme_droite",
    "DVC": "divers", "DIV": "divers", "REG": "divers",
}
OTHER_BLOC = "divers"
#: Tier of each provider, as tables have it.
TIERS = {"curated": "tier1_curated", "gdelt": "tier2_gdelt", "gnews": "tier3_api"}

COG_COLUMNS = {"COM": "commune_insee", "LIBELLE": "commune_name", "DEP": "dep_code", "REG": "reg_code", "TYPECOM": "typecom"}
SEATS_COLUMNS = {
    "CODE_DPT": "dep_code", "LIB_DPT": "dep_name", "CODE_EPCI": "epci_code", "LIB_EPCI": "epci_name", "CODE_COMMUNE": "commune_insee", "LIB_COMMUNE": "commune_name",
    "CODE_COM_ASSOCIEE": "associated_commune_code", "LIB_COM_ASSOCIEE": "associated_commune_name", "NBRE_BV": "polling_station_count", "POPULATION": "population",
    "INSCRITS": "registered_voters", "NBRE_SAP_COM": "seats_municipal", "NBRE_SAP_EPCI": "seats_epci",
}
CANDIDATE_COLUMNS = {
    "Code département": "dep_code", "Département": "dep_name", "Code circonscription": "commune_insee", "Circonscription": "commune_name", "Numéro de panneau": "list_id",
    "Libellé abrégé de liste": "list_label_short", "Libellé de la liste": "list_label", "Code nuance de liste": "list_nuance", "Nuance de liste": "list_nuance_label",
    "Tête de liste": "is_list_leader", "Ordre": "position_on_list", "Sexe": "gender", "Nom sur le bulletin de vote": "family_name", "Prénom sur le bulletin de vote": "given_name",
    "Nationalité": "nationality", "Code personnalité": "personality_code", "CC": "candidate_category",
}
INCUMBENT_COLUMNS = {
    "Code du département": "dep_code", "Libellé du département": "dep_name", "Code de la collectivité à statut particulier": "special_collectivity_code",
    "Libellé de la collectivité à statut particulier": "special_collectivity_name", "Code de la commune": "commune_insee", "Libellé de la commune": "commune_name",
    "Nom de l'élu": "family_name", "Prénom de l'élu": "given_name", "Code sexe": "gender", "Date de naissance": "birth_date",
    "Code de la catégorie socio-professionnelle": "socio_professional_code", "Libellé de la catégorie socio-professionnelle": "socio_professional_label",
    "Date de début du mandat": "mandate_start_date", "Date de début de la fonction": "function_start_date",
}
TRACKING_KEYS = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
SECRET_KEYS = ("access_token", "api_key", "apikey", "key", "token")
ELECTION_KEYWORDS = ("municipales", "maire", "mairie", "liste")


def arrondissement_parents() -> dict[str, str]:
    """Sub-district codes of the three cities that vote by sub-district, with their commune."""
    spans = (("75056", "75", range(101, 121)), ("69123", "69", range(381, 390)), ("13055", "13", range(201, 217)))
    return {f"{prefix}{n}": city for city, prefix, numbers in spans for n in numbers}


@dataclass(frozen=True)
class Outlet:
    """A news outlet: connector capability, role, wave, whether it is searched, and its documents."""

    outlet_key: str
    display_name: str
    connector_capability: str
    recommended_role: str
    benchmark_wave: str
    enabled: bool
    rss_urls: tuple[str, ...] = ()
    sitemap_urls: tuple[str, ...] = ()
    html_index_urls: tuple[str, ...] = ()


# The outlets in catalog order.
_REAL, _HIST, _BROWSER = "realtime_only", "historical_capable", "browser_required"
_FIRST, _CANDIDATE, _TRUTH = "benchmark_first", "production_candidate", "truth_only"
OUTLETS: dict[str, Outlet] = {
    o.outlet_key: o
    for o in (
        Outlet("lemonde.fr", "Le Monde", _REAL, _FIRST, "wave_1", True, ("https://www.lemonde.fr/rss/une.xml", "https://www.lemonde.fr/france/rss_full.xml")),
        Outlet("lefigaro.fr", "Le Figaro", _REAL, _FIRST, "wave_1", True, ("https://www.lefigaro.fr/rss/figaro_actualites.xml",)),
        Outlet("franceinfo.fr", "Franceinfo", _REAL, _CANDIDATE, "wave_1", True, ("https://www.francetvinfo.fr/titres.rss",)),
        Outlet(
            "france3-regions.franceinfo.fr", "France 3 Regions", _BROWSER, _CANDIDATE, "wave_1", False,
            html_index_urls=tuple(f"https://france3-regions.francetvinfo.fr/{r}/" for r in ("paris-ile-de-france", "bretagne", "hauts-de-france", "nouvelle-aquitaine")),
        ),
        Outlet("leparisien.fr", "Le Parisien", _REAL, _CANDIDATE, "wave_1", True, ("https://feeds.leparisien.fr/leparisien/rss/politique",)),
        Outlet("ouest-france.fr", "Ouest-France", _BROWSER, _CANDIDATE, "wave_1", False, ("https://www.ouest-france.fr/rss/une.xml",)),
        Outlet("sudouest.fr", "Sud Ouest", _BROWSER, _CANDIDATE, "wave_1", False, ("https://www.sudouest.fr/arc/outboundfeeds/rss/",)),
        Outlet("ici.fr", "ici.fr", _BROWSER, _CANDIDATE, "wave_1", False, html_index_urls=tuple(f"https://www.ici.fr/{r}" for r in ("107-1", "armorique", "nord", "poitou", "la-rochelle"))),
        Outlet("actu.fr", "Actu.fr", _BROWSER, _FIRST, "wave_1", False, sitemap_urls=("https://actu.fr/sitemap_index.xml",)),
        Outlet("bfmtv.com", "BFM TV", _REAL, _FIRST, "wave_2", True, ("https://www.bfmtv.com/rss/news-24-7/",)),
        Outlet("lavoixdunord.fr", "La Voix du Nord", _BROWSER, _TRUTH, "wave_3", False, ("https://www.lavoixdunord.fr/arc/outboundfeeds/rss/",)),
        Outlet("francebleu.fr", "France Bleu", _BROWSER, _FIRST, "wave_2", False, ("https://www.francebleu.fr/rss",)),
        Outlet("laprovence.com", "La Provence", _BROWSER, _CANDIDATE, "wave_2", False, ("https://www.laprovence.com/arc/outboundfeeds/rss/",), ("https://www.laprovence.com/arc/outboundfeeds/sitemap/",)),
        Outlet("letelegramme.fr", "Le Télégramme", _BROWSER, _CANDIDATE, "wave_2", False, ("https://www.letelegramme.fr/rss/titres.rss",), ("https://www.letelegramme.fr/sitemap.xml",)),
        Outlet("lanouvellerepublique.fr", "La Nouvelle République", _BROWSER, _CANDIDATE, "wave_2", False, ("https://www.lanouvellerepublique.fr/arc/outboundfeeds/rss/",), ("https://www.lanouvellerepublique.fr/arc/outboundfeeds/sitemap/",)),
        Outlet("nicematin.com", "Nice-Matin", _BROWSER, _CANDIDATE, "wave_2", False, ("https://www.nicematin.com/arc/outboundfeeds/rss/",), ("https://www.nicematin.com/arc/outboundfeeds/sitemap/",)),
        Outlet("paris-normandie.fr", "Paris-Normandie", _BROWSER, _CANDIDATE, "wave_2", False, ("https://www.paris-normandie.fr/feed",)),
        Outlet("varmatin.com", "Var-Matin", _BROWSER, _CANDIDATE, "wave_2", False, ("https://www.varmatin.com/arc/outboundfeeds/rss/",), ("https://www.varmatin.com/arc/outboundfeeds/sitemap/",)),
        Outlet("mediapart.fr", "Mediapart", _REAL, _CANDIDATE, "wave_3", True, ("https://www.mediapart.fr/articles/feed",)),
        Outlet("lcp.fr", "LCP", _BROWSER, _CANDIDATE, "wave_3", False, ("https://www.lcp.fr/rss",)),
        Outlet("publicsenat.fr", "Public Sénat", _BROWSER, _CANDIDATE, "wave_3", False, ("https://www.publicsenat.fr/rss/toutes-les-actualites.rss",)),
        Outlet("94.citoyens.com", "94 Citoyens", _BROWSER, _CANDIDATE, "wave_3", False, ("https://94.citoyens.com/feed",), ("https://94.citoyens.com/sitemap_index.xml",)),
        Outlet("rue89strasbourg.com", "Rue89 Strasbourg", _HIST, _CANDIDATE, "wave_3", True, ("https://www.rue89strasbourg.com/feed",), ("https://www.rue89strasbourg.com/sitemap_index.xml",)),
        Outlet("marsactu.fr", "Marsactu", _HIST, _CANDIDATE, "wave_3", True, ("https://marsactu.fr/feed",), ("https://marsactu.fr/sitemap_index.xml",)),
        Outlet("lyoncapitale.fr", "Lyon Capitale", _REAL, _CANDIDATE, "wave_3", True, ("https://www.lyoncapitale.fr/rss/",)),
        Outlet("madeinmarseille.net", "Made in Marseille", _BROWSER, _CANDIDATE, "wave_3", False, ("https://www.madeinmarseille.net/feed",), ("https://www.madeinmarseille.net/sitemap_index.xml",)),
    )
}


def csv_list(text: str) -> tuple[str, ...]:
    return tuple(x for x in (part.strip() for part in text.split(",")) if x)


@dataclass(frozen=True)
class Settings:
    """Every tunable; ``from_env`` reads an upper-cased field name from a mapping."""

    analysis_start_date: str = "2026-02-01"
    analysis_end_date: str = "2026-04-30"
    candidate_sample_size: int = 24
    data_dir: str = "data"
    warehouse_path: str = "warehouse"
    gdelt_max_records: int = 250
    gdelt_near_cap: float = 0.95
    gdelt_request_delay_seconds: float = 2.0
    news_provider_order: tuple[str, ...] = ("curated", "gnews")
    news_benchmark_provider_order: tuple[str, ...] = ("curated", "gnews")
    gnews_api_key: str = ""
    gnews_max_articles_per_page: int = 10
    gnews_max_pages_per_query: int = 3
    filesystem_path_budget: int = 240
    scrape_request_timeout_seconds: int = 30
    scrape_retry_max_attempts: int = 3
    scrape_retry_backoff_seconds: float = 5.0
    rate_limit_backoff_seconds: float = 30.0
    sitemap_depth: int = 2
    sitemap_children: int = 20
    verification_fetches: int = 15
    dq_min_article_text_length: int = 100
    dq_max_null_rate: float = 0.05
    city_size_large: int = 100_000
    city_size_medium: int = 20_000
    city_size_small: int = 3_500
    sample_min_region_count: int = 4
    sampling_random_seed: int = 42
    incumbent_match_threshold: int = 85
    quotas: Mapping[str, int] = field(default_factory=lambda: {"large": 4, "medium": 8, "small": 12})
    keep_body_text: bool = True

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        given = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None or f.name == "quotas":
                continue
            now = getattr(cls, f.name, None)
            given[f.name] = csv_list(raw) if isinstance(now, tuple) else raw.lower() in ("1", "true", "yes") if isinstance(now, bool) else type(now)(raw)
        return cls(**given)


DEFAULTS = Settings()
