"""Message lists derived from metrics. Message texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import rules as R
from statloom.functions.common import chain, col, let, messages

# Two messages per topic.
TOPIC_ADVICE = {
    "monetary_financial": [
        "Analyser l'impact des décisions BCT sur l'économie réelle",
        "Suivre l'évolution des taux d'intérêt et de l'inflation",
    ],
    "statistical_demographic": [
        "Croiser avec données INS pour validation",
        "Analyser les tendances démographiques à long terme",
    ],
    "industrial_production": [
        "Analyser la compétitivité sectorielle",
        "Évaluer les opportunités d'exportation",
    ],
    "trade_commerce": [
        "Analyser la balance commerciale",
        "Identifier les partenaires stratégiques",
    ],
    "employment_social": [
        "Analyser les politiques d'emploi",
        "Évaluer l'adéquation formation-emploi",
    ],
}
TOPIC_DEFAULTS = [
    "Valider avec des sources officielles tunisiennes",
    "Analyser dans le contexte économique tunisien",
]
QUALITY_ADVICE = {
    "low": "Rechercher des sources officielles complémentaires",
    "high": "Données fiables - utiliser pour analyse approfondie",
    "old": "Rechercher des données plus récentes",
    "basic": "Approfondir avec des sources spécialisées",
}
ALL_TOPIC_ADVICE = [m for pair in TOPIC_ADVICE.values() for m in pair] + list(QUALITY_ADVICE.values()) + TOPIC_DEFAULTS
EXTRACTION_NONE = [
    "Vérifier si l'URL retourne du contenu",
    "Ajuster les patterns d'extraction",
    "Essayer la stratégie alternative",
    "Réduire les seuils de validation",
]
EXTRACTION_LOW = [
    "Réduire le seuil de confiance minimum",
    "Améliorer la validation des indicateurs",
    "Vérifier la catégorisation automatique",
]
EXTRACTION_FEW = [
    "Enrichir les patterns d'extraction",
    "Tester avec des seuils plus permissifs",
    "Vérifier la pertinence des mots-clés",
]
EXTRACTION_FINE = ["Extraction fonctionnelle - optimisations mineures possibles"]


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def for_topic(topic, credible, recent, specialisation, limit: int = 4) -> Column:
    """Topic messages, then quality messages; general ones fill a short list."""
    by_topic = chain(
        [(col(topic) == name, _texts(texts)) for name, texts in TOPIC_ADVICE.items()],
        F.array().cast("array<string>"),
    )
    q = QUALITY_ADVICE
    by_quality = messages(
        F.when(col(credible) == "low", q["low"]).when(col(credible) == "high", q["high"]),
        F.when(~col(recent), q["old"]),
        F.when(col(specialisation) == "basic", q["basic"]),
    )

    def filled(listed: Column) -> Column:
        return F.slice(F.when(F.size(listed) < 2, F.concat(listed, _texts(TOPIC_DEFAULTS))).otherwise(listed), 1, limit)

    return let(F.concat(by_topic, by_quality), filled)


def for_extraction(total, low) -> Column:
    """From the value count of a page and its count of low-confidence values."""
    return chain(
        [
            (col(total) == 0, _texts(EXTRACTION_NONE)),
            (col(low) > col(total) * 0.7, _texts(EXTRACTION_LOW)),
            (col(total) < 3, _texts(EXTRACTION_FEW)),
        ],
        _texts(EXTRACTION_FINE),
    )


def debug_note(total, low, high) -> Column:
    return chain(
        [
            (col(total) == 0, F.lit("Aucune valeur extraite - vérifier les patterns d'extraction")),
            (col(low) > col(total) * 0.5, F.lit("Beaucoup de valeurs à faible confiance - ajuster les seuils")),
            (col(high) > 0, F.lit("Extraction réussie avec de bonnes valeurs")),
        ],
        F.lit(""),
    )


def validation_warnings(outside, no_year, patterns, errors, total) -> Column:
    def line(count, reason):
        return F.when(col(count) > 0, F.concat(col(count).cast("string"), F.lit(f" éléments rejetés ({reason})")))

    rejected = col(outside) + col(no_year) + col(patterns) + col(errors)
    rate = F.when(col(total) > 0, rejected / col(total) * 100).otherwise(0.0)
    return messages(
        line(outside, "hors période 2018-2025"),
        line(no_year, "année non trouvée"),
        line(patterns, "patterns non-économiques"),
        F.when(col(errors) > 0, F.concat(col(errors).cast("string"), F.lit(" erreurs de validation"))),
        F.when(
            rate > 80,
            F.concat(F.lit("Taux de rejet élevé ("), F.format_number(rate, 1), F.lit("%) - vérifier la qualité des données source")),
        ),
    )


def for_routes(success_rate, mean_seconds) -> Column:
    rate, t = col(success_rate), col(mean_seconds)
    return messages(
        chain(
            [
                (rate > 0.9, F.lit("Performance excellente - système optimal")),
                (rate > 0.7, F.lit("Bonne performance - quelques optimisations possibles")),
                (rate > 0.5, F.lit("Performance acceptable - révision des sources recommandée")),
            ],
            F.lit("Performance faible - vérifier la connectivité et les sources"),
        ),
        F.when(t > 30, "Temps de traitement élevé - optimisation recommandée").when(
            t < 5, "Traitement très rapide - capacité disponible pour plus de sources"
        ),
    )


def for_runs(success_rate, mean_seconds, mean_quality) -> Column:
    rate, t = col(success_rate), col(mean_seconds)
    return messages(
        chain(
            [
                (rate > 0.9, F.lit("Performance excellente - système optimal")),
                (rate > 0.7, F.lit("Bonne performance - optimisations mineures possibles")),
            ],
            F.lit("Performance à améliorer - révision nécessaire"),
        ),
        F.when(t > 120, "Temps de traitement élevé - considérer plus de workers").when(
            t < 30, "Traitement rapide - capacité pour plus de sources"
        ),
        F.when(col(mean_quality) < 0.5, "Qualité faible - améliorer la sélection des sources"),
    )


def for_navigation(success_rate, discovery_rate, mean_seconds) -> Column:
    rate, t = col(success_rate), col(mean_seconds)
    return messages(
        chain(
            [
                (rate > 0.8, F.lit("Performance de navigation excellente - système optimisé")),
                (rate > 0.6, F.lit("Bonne performance - optimisations mineures possibles")),
            ],
            F.lit("Performance de navigation à améliorer"),
        ),
        F.when(col(discovery_rate) < 0.3, "Taux de découverte faible - réviser les patterns de détection"),
        F.when(t > 60, "Temps d'exploration élevé - optimiser la profondeur").when(
            t < 10, "Exploration rapide - capacité pour plus de profondeur"
        ),
    )


def for_analysis(success_rate, mean_confidence, mean_seconds, model_rate) -> Column:
    rate, conf, model = col(success_rate), col(mean_confidence), col(model_rate)
    return messages(
        chain(
            [
                ((rate > 0.9) & (conf > 0.8), F.lit("Performance excellente - système optimisé")),
                (rate > 0.7, F.lit("Bonne performance - quelques améliorations possibles")),
            ],
            F.lit("Performance à améliorer - réviser les sources"),
        ),
        F.when(conf < 0.5, "Confiance faible - enrichir les données d'entrée"),
        F.when(col(mean_seconds) > 10, "Temps de traitement élevé - optimiser les requêtes LLM"),
        F.when(model < 0.3, "LLM défaillant - vérifier la connectivité Ollama")
        .when(model < 0.6, "LLM instable - optimiser les timeouts")
        .when(model > 0.8, "LLM performant - analyses enrichies disponibles"),
    )


def for_synthesis(success_rate, top_advice, topic, n_discovered, limit: int = 5) -> Column:
    rate = col(success_rate)
    head = messages(
        F.when(rate > 0.8, "Extraction excellente - données fiables pour analyse").when(
            rate < 0.5, "Taux d'extraction faible - réviser les sources"
        )
    )
    tail = messages(
        F.when(
            col(topic) != "general",
            F.concat(F.lit("Focus sur "), col(topic), F.lit(" - spécialisation détectée")),
        ),
        F.when(col(n_discovered) > 5, "Nombreuses sources découvertes - potentiel d'expansion"),
    )
    return F.slice(F.concat(head, F.slice(col(top_advice), 1, 2), tail), 1, limit)


def for_targets(coverage, missing, unit_score, temporal_score, n_years, n_priority, level) -> Column:
    """Coverage report messages; ``missing`` is the sorted array of uncovered categories."""
    pct, gone = col(coverage), col(missing)
    shown = F.format_number(pct, 1)
    n_target_years = str(len(R.TARGET_YEARS))
    coverage_lines = chain(
        [
            (
                pct == 0,
                _texts(
                    [
                        "🚨 CRITIQUE: Aucun TARGET_INDICATOR détecté - Vérifier la compatibilité du scraper",
                        "🔧 Implémenter les patterns spécifiques pour TARGET_INDICATORS",
                    ]
                ),
            ),
            (
                pct < 30,
                F.array(
                    F.concat(F.lit("⚠️ Couverture TARGET faible ("), shown, F.lit("%) - Optimiser l'extraction")),
                    F.lit("🎯 Créer des extracteurs spécialisés par catégorie TARGET"),
                ),
            ),
        ],
        F.array(F.concat(F.lit("✅ Couverture TARGET acceptable ("), shown, F.lit("%)"))),
    )
    missing_lines = F.when(
        F.size(gone) > 0,
        F.concat(
            F.array(F.concat(F.lit("📋 Catégories TARGET manquantes: "), F.array_join(gone, ", "))),
            F.transform(gone, lambda g: F.concat(F.lit("🔍 Développer patterns pour "), g)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    rest = messages(
        F.when(col(unit_score) < 0.5, "📏 Améliorer la détection des RECOGNIZED_UNITS"),
        F.when(col(unit_score) < 0.5, "🔧 Implémenter la normalisation des unités selon settings"),
        F.when(
            col(temporal_score) < 0.3,
            F.concat(
                F.lit("📅 Couverture temporelle faible ("), col(n_years).cast("string"), F.lit(f"/{n_target_years} années)")
            ),
        ),
        F.when(col(temporal_score) < 0.3, "🕐 Développer l'extraction de données historiques TARGET_YEARS"),
        F.when(col(n_priority) == 0, "🤖 Activer le mode 'intelligent' pour extraction TARGET avancée"),
        F.when(col(n_priority) == 0, "🚀 Tester l'analyse LLM pour identifier les TARGET_INDICATORS"),
        F.when(
            col(level).isin("poor", "fair"),
            F.concat(F.lit("📈 Qualité globale "), col(level), F.lit(" - Optimisations nécessaires")),
        ),
        F.when(col(level).isin("poor", "fair"), "🔄 Réviser les patterns d'extraction pour TARGET_INDICATORS"),
        F.lit("💾 Sauvegarder les TARGET_INDICATORS extraits pour analyse historique"),
        F.lit("📊 Créer un dashboard de suivi des TARGET_INDICATORS"),
        F.lit("🔄 Programmer extractions régulières selon TARGET_YEARS"),
    )
    return F.concat(coverage_lines, missing_lines, rest)


def for_inventory(url, n_tables, n_numbers, n_data_links) -> Column:
    """Advice per page from its inventory."""
    head = F.concat(F.lit("URL "), col(url), F.lit(": "))
    return messages(
        F.when(col(n_tables) == 0, F.concat(head, F.lit("Aucun tableau trouvé - probablement une page de navigation"))),
        F.when(col(n_numbers) < 5, F.concat(head, F.lit("Peu de données numériques - vérifier si c'est la bonne page"))),
        F.when(col(n_data_links) > 0, F.concat(head, F.lit("Liens vers données trouvés - explorer ces liens"))),
    )
