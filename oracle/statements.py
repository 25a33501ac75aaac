"""One SQL statement per analysis."""

from __future__ import annotations

from oracle.base import (
    CHURN_INTENDED, CHURN_OBSERVED, NOISE_SQL, labels, quoted, r, statement, text, values,
)

MONTHLY = """
    SELECT strftime(r.rental_date, '%Y-%m') AS month, count(*) AS rentals,
           count(DISTINCT r.customer_id) AS unique_customers, sum(p.amount)::DOUBLE AS revenue,
           count(*) FILTER (WHERE date_diff('microsecond', r.rental_date, r.return_date)
               > f.rental_duration * 86400000000) AS late_returns
    FROM rental r JOIN film f ON r.inventory_id = f.film_id
    LEFT JOIN payment p ON r.rental_id = p.rental_id GROUP BY 1"""
CATEGORY = f"""
    SELECT f.category, count(*) AS rentals, count(DISTINCT r.customer_id) AS unique_customers,
           sum(p.amount)::DOUBLE AS revenue, {r("sum(p.amount)::DOUBLE / count(p.amount)", "avg_payment")},
           count(*) FILTER (WHERE date_diff('microsecond', r.rental_date, r.return_date)
               > f.rental_duration * 86400000000) AS late_count,
           {r('''avg(greatest(date_diff('microsecond', r.rental_date, r.return_date)
               - f.rental_duration * 86400000000, 0)) / 86400000000.0''', "avg_overdue_days")}
    FROM rental r JOIN film f ON r.inventory_id = f.film_id
    LEFT JOIN payment p ON r.rental_id = p.rental_id GROUP BY 1"""
WEEKDAY = """
    SELECT dayofweek(r.rental_date)::INTEGER AS dow_num, strftime(r.rental_date, '%a') AS day_label,
           CASE WHEN dayofweek(r.rental_date) IN (0,6) THEN 'Weekend' ELSE 'Weekday' END AS day_type,
           count(*) AS rentals, sum(p.amount)::DOUBLE AS revenue
    FROM rental r LEFT JOIN payment p ON r.rental_id = p.rental_id GROUP BY 1, 2, 3"""
PROFILE = f"""
    SELECT customer_id, full_name, city, country, active, total_rentals, total_spending,
           last_rental_date, first_rental_date, late_return_count, {r("avg_days_overdue", "avg_days_overdue")},
           weekend_rentals, {r("avg_spend_per_rental", "avg_spend_per_rental")}, late_return_rate,
           days_since_last_rental, customer_tenure_days, pct_weekend, avg_rentals_per_month,
           {r("avg_rental_gap_days", "avg_rental_gap_days")}, unique_genres, top_genre, genre_diversity,
           {r("risk_score", "risk_score")}, is_high_risk, spending_tier, rfm_segment
    FROM profile"""
TABLE = """
    SELECT customer_id, full_name, city, country, total_rentals, total_spending, late_return_rate,
           rfm_segment, round_even(risk_score, 6) AS risk_score, is_high_risk, spending_tier
    FROM profile ORDER BY {order}, customer_id"""
TABLE_ORDERS = {
    "name_asc": "profile.full_name", "name_desc": "profile.full_name DESC",
    "spending_desc": "profile.total_spending DESC", "spending_asc": "profile.total_spending",
    "rentals_desc": "profile.total_rentals DESC", "rentals_asc": "profile.total_rentals",
    "risk_desc": "profile.risk_score DESC",
}
FOUND = """
    SELECT customer_id, full_name, city, country, rfm_segment, is_high_risk FROM profile
    WHERE {condition} ORDER BY customer_id"""
NEXT_GENRE = f"""
    SELECT customer_id, last_category, last_film, last_date, position::INTEGER AS position,
           next_category, n AS count, {r("prob", "prob")}, {r("adjusted_prob", "adjusted_prob")},
           {r("(adjusted_prob - prob) * 100", "boost_pct")}
    FROM predicted WHERE position <= 6"""
RECOMMENDED = """
    SELECT customer_id, position::INTEGER AS position, genre_rank::INTEGER AS genre_rank, category,
           film_id, title, rating, rental_duration, rental_rate,
           CASE WHEN is_high_risk AND rental_duration <= 4 THEN {short}
                WHEN NOT is_high_risk AND rental_rate >= 2.99 THEN {premium} ELSE {match} END AS note
    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
                ORDER BY genre_rank, category, within) AS position
          FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, category ORDER BY
                        CASE WHEN is_high_risk THEN rental_duration ELSE 0 END,
                        CASE WHEN is_high_risk THEN rental_rate ELSE -rental_rate END, film_id) AS within
                FROM (SELECT p.customer_id, p.is_high_risk, f.*, coalesce(t.{rank}, 999) AS genre_rank
                      FROM profile p CROSS JOIN film f
                      LEFT JOIN taste t ON t.customer_id = p.customer_id AND t.category = f.category
                      WHERE NOT EXISTS (SELECT 1 FROM fact x
                            WHERE x.customer_id = p.customer_id AND x.film_id = f.film_id)))
          WHERE within <= 2)
    WHERE position <= 12"""
NOTES = {
    "short": quoted(labels.NOTE_SHORT), "premium": quoted(labels.NOTE_PREMIUM),
    "match": quoted(labels.NOTE_MATCH),
}
SHARES = """
    SELECT country, category, count(*) AS rentals,
           round_even(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY country) * 100, 1) AS share
    FROM fact WHERE country IS NOT NULL GROUP BY country, category"""
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
SHARED = """
    SELECT a.category AS genre_a, b.category AS genre_b, count(*) AS customers
    FROM taste a JOIN taste b ON a.customer_id = b.customer_id AND a.category <> b.category
    GROUP BY 1, 2"""
GENRES = "(SELECT DISTINCT category FROM taste)"


def card(tier: str, condition: str, title: str, body: str) -> str:
    return (
        f"SELECT customer_id, {quoted(tier)} AS tier, {quoted(title)} AS title, {body} AS body "
        f"FROM profile WHERE {condition}"
    )


def customer_cards() -> str:
    fill = {
        "late_pct": "format('{:.0f}', late_return_rate * 100)",
        "days": "days_since_last_rental", "rentals": "total_rentals", "tier": "spending_tier",
        "genre": "top_genre", "diversity": "format('{:.2f}', genre_diversity)",
    }
    leaving = "rfm_segment IN ('At Risk', 'Lost')"
    rules = {
        "Immediate": (labels.IMMEDIATE, {
            "remind": "is_high_risk AND late_return_rate > 0.3",
            "reactivate": f"days_since_last_rental > 60 AND {leaving}",
            "win_back": "rfm_segment = 'Lost' AND days_since_last_rental > 120",
        }),
        "Short-Term": (labels.SHORT_TERM, {
            "vip": "rfm_segment = 'Champions'",
            "limit": "is_high_risk",
            "upsell": "rfm_segment = 'Loyal' AND NOT is_high_risk",
            "promote": "rfm_segment = 'At Risk' AND NOT is_high_risk",
        }),
        "Long-Term": (labels.LONG_TERM, {
            "lifetime": "spending_tier IN ('Top Spender', 'High Spender')",
            "broaden": "genre_diversity < 0.2",
            "prevent": leaving,
        }),
    }
    parts = []
    for tier, (texts, conditions) in rules.items():
        conditions = {
            **conditions,
            "none": "NOT (" + " OR ".join(f"({c})" for c in conditions.values()) + ")",
        }
        for name, condition in conditions.items():
            title, body = texts[name]
            parts.append(card(tier, condition, title, text(body, **fill)))
    return " UNION ALL ".join(parts)


def churn_statements(churn: str, suffix: str) -> dict[str, str]:
    high = "churn_risk_label = 'High Churn Risk'"
    money = "coalesce(sum(total_spending::DECIMAL(18,2)), 0)::DOUBLE"
    statements = {
        "churn_scores": """
            SELECT customer_id, rfm_segment, days_since_last_rental, total_rentals, churn_score,
                   churn_risk_label FROM churn""",
        "churn_bands": f"""
            SELECT v.position, v.label AS churn_risk_label, count(c.customer_id) AS customers,
                   {money} AS revenue
            FROM {values("label", labels.CHURN_ORDER)} LEFT JOIN churn c ON c.churn_risk_label = v.label
            GROUP BY v.position, v.label""",
        "churn_by_segment": f"""
            SELECT rfm_segment, {r("sum(churn_score::DECIMAL(18,3))::DOUBLE / count(churn_score)", "avg_churn_score")} FROM churn GROUP BY 1""",
        "churn_revenue_by_country": f"""
            SELECT country, {money} AS revenue_at_risk FROM churn WHERE {high}
            GROUP BY country ORDER BY revenue_at_risk DESC, country LIMIT 15""",
        "top_churn": """
            SELECT customer_id, full_name, city, country, rfm_segment, days_since_last_rental,
                   total_rentals, total_spending, churn_score, churn_risk_label
            FROM churn ORDER BY churn_score DESC, customer_id LIMIT 10""",
        "revenue_at_risk": f"SELECT {money} AS revenue_at_risk FROM churn WHERE {high}",
    }
    return {f"{n}{suffix}": statement(s, churn=churn) for n, s in statements.items()}


def next_genre_cards() -> str:
    fill = {"name": "full_name", "next": "next_category", "last": "last_category"}
    return " UNION ALL ".join(
        f"SELECT x.customer_id, {quoted(tier)} AS tier, {quoted(title)} AS title, "
        f"{text(body, **fill)} AS body FROM predicted x JOIN measures m "
        "ON x.customer_id = m.customer_id WHERE x.position = 1"
        for tier, (title, body) in zip(labels.TIERS, labels.NEXT_GENRE_ACTIONS, strict=True)
    )


def churn_cards() -> str:
    total = (
        "SELECT coalesce(sum(total_spending::DECIMAL(18,2)), 0)::DOUBLE AS revenue FROM churn "
        "WHERE churn_risk_label = 'High Churn Risk'"
    )
    fill = {"revenue": "format('{:,}', round_even(revenue, 0)::BIGINT)"}
    return " UNION ALL ".join(
        f"SELECT {quoted(tier)} AS tier, {quoted(title)} AS title, {text(body, **fill)} AS body "
        f"FROM ({total})"
        for tier, (title, body) in zip(labels.TIERS, labels.CHURN_ACTIONS, strict=True)
    )


def segment_cards() -> str:
    rows = [
        f"SELECT {i} AS position, {quoted(segment)} AS rfm_segment, {quoted(title)} AS title, "
        f"{text(body, n=f'SELECT count(*) FROM profile WHERE rfm_segment = {quoted(segment)}')} AS body"
        for i, (segment, (title, body)) in enumerate(labels.SEGMENT_ACTIONS.items())
    ]
    return " UNION ALL ".join(rows)


FACT = f"""
    SELECT rental_id, rental_date, return_date, day_of_week_num, day_of_week, day_type,
           rental_month, customer_id, full_name, email, active, city, country, film_id, title,
           allowed_days, rental_rate, film_length_min, rating, category,
           amount::DOUBLE AS amount, {r("rental_duration_actual", "rental_duration_actual")},
           {r("overdue_us / 86400000000.0::DOUBLE", "days_overdue")}, is_late_return
    FROM fact"""

STATEMENTS: dict[str, str] = {
    "monthly_trend": statement(f"{MONTHLY} ORDER BY 1"),
    "peak_month": statement(
        f"SELECT month, rentals FROM ({MONTHLY}) ORDER BY rentals DESC, month LIMIT 1"
    ),
    "rental_fact": statement(FACT),
    "customer_rentals": statement(f"{FACT} WHERE customer_id = 42"),
    "rentals_per_city": statement("""
        SELECT p.city, count(*) AS rentals, count(DISTINCT r.customer_id) AS customers
        FROM rental r JOIN person p ON r.customer_id = p.customer_id
        WHERE p.country = 'NATION_7' GROUP BY p.city"""),
    "film_catalogue": statement("""
        SELECT film_id, title, description, release_year, rental_duration, rental_rate, length,
               rating, replacement_cost, category FROM film ORDER BY film_id"""),
    "dataset_counts": statement("""
        SELECT (SELECT count(DISTINCT customer_id) FROM fact) AS customers,
               (SELECT count(*) FROM film) AS films, (SELECT count(*) FROM fact) AS rentals"""),
    "value_lists": statement("""
        SELECT DISTINCT 'category' AS kind, category AS value FROM fact
        UNION SELECT DISTINCT 'country', country FROM fact WHERE country IS NOT NULL"""),
    "category_stats": statement(CATEGORY),
    "category_revenue": statement(f"SELECT category, revenue FROM ({CATEGORY})"),
    "category_late_rate": statement(f"""
        SELECT category, rentals, late_count,
               {r("late_count::DOUBLE / rentals * 100", "late_rate")} FROM ({CATEGORY})"""),
    "dayofweek_stats": statement(WEEKDAY),
    "dayofweek_chart": statement(f"""
        SELECT v.position, v.day_label, w.day_type, w.rentals, w.revenue
        FROM {values("day_label", labels.DAY_ORDER)} LEFT JOIN ({WEEKDAY}) w ON v.day_label = w.day_label"""),
    "snapshot_kpis": statement(f"""
        SELECT count(DISTINCT customer_id) AS total_customers, sum(amount)::DOUBLE AS total_revenue,
               count(*) AS total_rentals,
               {r("sum(amount)::DOUBLE / count(DISTINCT customer_id)", "revenue_per_customer")},
               (SELECT sum(active)::BIGINT FROM measures) AS active_customers,
               count(*) FILTER (WHERE is_late_return) AS late_returns,
               count(return_date) AS returned_rentals,
               {r("CASE WHEN count(return_date) > 0 THEN count(*) FILTER (WHERE is_late_return)::DOUBLE / count(return_date) * 100 ELSE 0 END", "late_return_pct")}
        FROM fact"""),
    "customer_profiles": statement(PROFILE),
    "customer_profiles_noisy": statement(PROFILE, noise=NOISE_SQL),
    "customer_profiles_by_parts": statement(PROFILE),
    "customer_profiles_plain": statement(PROFILE, noise="0"),
    "segment_overview": statement(f"""
        SELECT v.position, v.rfm_segment, count(p.customer_id) AS customers,
               coalesce(sum(p.total_spending::DECIMAL(18,2)), 0)::DOUBLE AS revenue,
               {r("count(p.customer_id)::DOUBLE / (SELECT count(*) FROM profile) * 100", "pct_customers")}
        FROM {values("rfm_segment", labels.SEGMENT_ORDER)} LEFT JOIN profile p ON p.rfm_segment = v.rfm_segment
        GROUP BY v.position, v.rfm_segment"""),
    "customer_table_written": statement(TABLE.format(order="profile.customer_id")),
    "tier_breakdown": statement(f"""
        SELECT v.position, v.spending_tier, count(p.customer_id) AS customers
        FROM {values("spending_tier", labels.TIER_ORDER)} LEFT JOIN profile p ON p.spending_tier = v.spending_tier
        GROUP BY v.position, v.spending_tier"""),
    "tier_breakdown_filtered": statement(f"""
        SELECT v.position, v.spending_tier, count(p.customer_id) AS customers
        FROM {values("spending_tier", labels.TIER_ORDER)} LEFT JOIN profile p
          ON p.spending_tier = v.spending_tier AND p.is_high_risk
          AND p.rfm_segment IN ('Champions', 'Loyal') AND p.country IN ('NATION_1', 'NATION_2', 'NATION_3')
        GROUP BY v.position, v.spending_tier"""),
    "segment_recency": statement(f"""
        SELECT rfm_segment, {r("avg(days_since_last_rental)", "avg_days_since_last_rental")}
        FROM profile GROUP BY 1"""),
    "segment_value": statement(f"""
        SELECT rfm_segment, {r("sum(total_spending::DECIMAL(18,2))::DOUBLE / count(*)", "avg_spending")},
               count(*) AS customers FROM profile GROUP BY 1"""),
    **{
        f"customer_table_{name}": statement(TABLE.format(order=order))
        for name, order in TABLE_ORDERS.items()
    },
    "customer_search": statement(FOUND.format(
        condition="regexp_matches(full_name, 'building customer#0000000.1', 'i')")),
    "customer_search_segment": statement(FOUND.format(
        condition="regexp_matches(full_name, '(?i)^building ')")),
    "customer_search_either": statement(FOUND.format(
        condition="regexp_matches(full_name, 'machinery customer#00000001.$|household.*#0000002', 'i')")),
    "customer_search_no_gram": statement(FOUND.format(condition="regexp_matches(full_name, '[be]u?.*1.$', 'i')")),
    "customer_page_first": statement(TABLE.format(order=TABLE_ORDERS["name_asc"]) + " LIMIT 40"),
    "customer_page_risk": statement(TABLE.format(order=TABLE_ORDERS["risk_desc"]) + " LIMIT 50 OFFSET 100"),
    "customer_by_id": statement(FOUND.format(condition="customer_id = 42")),
    "return_split": statement("""
        SELECT customer_id, total_rentals - late_return_count AS on_time, late_return_count AS late
        FROM measures"""),
    "risk_split": statement(f"""
        SELECT count(*) FILTER (WHERE is_high_risk) AS high_risk,
               count(*) FILTER (WHERE NOT is_high_risk) AS low_risk,
               {r("count(*) FILTER (WHERE is_high_risk) * 100.0::DOUBLE / count(*)", "high_risk_pct")}
        FROM profile"""),
    "risk_by_segment": statement(f"""
        SELECT rfm_segment, {r("avg(is_high_risk::INTEGER) * 100", "high_risk_pct")} FROM profile GROUP BY 1"""),
    "top_risk": statement("""
        SELECT customer_id, full_name, city, country, total_rentals, late_return_count,
               round_even(late_return_rate * 100, 1) AS late_return_pct,
               round_even(avg_days_overdue, 1) AS avg_days_overdue, total_spending, rfm_segment,
               round_even(risk_score, 3) AS risk_score
        FROM profile WHERE is_high_risk ORDER BY profile.risk_score DESC, customer_id LIMIT 10"""),
    "customer_timeline": statement("""
        SELECT customer_id, rental_month, count(*) AS rentals, coalesce(sum(amount), 0)::DOUBLE AS spending,
               count(*) FILTER (WHERE is_late_return) AS late FROM fact GROUP BY 1, 2"""),
    "genre_preferences": statement("SELECT customer_id, category, n AS count FROM taste"),
    "genre_spend": statement("""
        SELECT customer_id, category, coalesce(sum(amount), 0)::DOUBLE AS amount FROM fact GROUP BY 1, 2"""),
    "genre_transitions": statement(f"""
        SELECT category, next_category, n AS count, {r("prob", "prob")} FROM transition"""),
    "next_genre": statement(NEXT_GENRE),
    "next_genre_preference": statement(NEXT_GENRE).replace("n_genres - alpha_rank", "n_genres - liked + 1"),
    "next_genre_films": statement("""
        SELECT customer_id, category, position, film_id, title, rating, rental_duration, rental_rate
        FROM (SELECT p.customer_id, f.*, row_number() OVER (PARTITION BY p.customer_id
                     ORDER BY f.rental_rate DESC, f.film_id)::INTEGER AS position
              FROM predicted p JOIN film f ON p.next_category = f.category
              WHERE p.position = 1 AND NOT EXISTS (SELECT 1 FROM fact x
                    WHERE x.customer_id = p.customer_id AND x.film_id = f.film_id))
        WHERE position <= 6"""),
    "film_recommendations": statement(RECOMMENDED.format(rank="alpha_rank", **NOTES)),
    "film_recommendations_preference": statement(
        RECOMMENDED.format(rank="liked - 1", **NOTES).replace("t.liked - 1", "(t.liked - 1)")),
    "genre_cooccurrence": statement(f"""
        SELECT a.category AS genre_a, b.category AS genre_b, coalesce(s.customers, 0) AS customers
        FROM {GENRES} a CROSS JOIN {GENRES} b
        LEFT JOIN ({SHARED}) s ON s.genre_a = a.category AND s.genre_b = b.category"""),
    "top_bundles": statement(f"""
        SELECT a.category AS genre_a, b.category AS genre_b, coalesce(s.customers, 0) AS customers,
               {r("coalesce(s.customers, 0)::DOUBLE / (SELECT count(*) FROM measures) * 100", "pct_customers")}
        FROM {GENRES} a JOIN {GENRES} b ON a.category < b.category
        LEFT JOIN ({SHARED}) s ON s.genre_a = a.category AND s.genre_b = b.category
        ORDER BY 3 DESC, 1, 2 LIMIT 5"""),
    "country_summary": statement(f"""
        SELECT country, count(*) AS customers,
               {r("sum(total_spending::DECIMAL(18,2))::DOUBLE / count(*)", "avg_spending")},
               {r("sum(late_return_rate::DECIMAL(18,4))::DOUBLE / count(*)", "avg_late")},
               count(*) FILTER (WHERE is_high_risk) AS high_risk
        FROM profile WHERE country IS NOT NULL GROUP BY country"""),
    "country_genre_share": statement(SHARES),
    "country_genre_pivot": statement(
        "SELECT country, "
        + ", ".join(f"coalesce(max(share) FILTER (WHERE category = '{b}'), 0.0::DOUBLE) AS \"{b}\"" for b in BRANDS)
        + f" FROM ({SHARES}) GROUP BY country"),
    "country_top_genre": statement(f"""
        SELECT s.country, s.category AS top_genre, s.share, m.customers
        FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY share DESC, category) AS k
              FROM ({SHARES})) s
        JOIN (SELECT country, count(*) AS customers FROM measures GROUP BY country) m ON m.country = s.country
        WHERE k = 1"""),
    **churn_statements(CHURN_OBSERVED, ""),
    **churn_statements(CHURN_INTENDED, "_intended"),
    "customer_actions": statement(customer_cards()),
    "segment_actions": statement(segment_cards()),
    "next_genre_actions": statement(next_genre_cards()),
    "churn_actions": statement(churn_cards()),
}
