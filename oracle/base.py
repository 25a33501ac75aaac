"""Common table expressions shared by the statements."""

from __future__ import annotations

from rentlens.functions import labels


def r(expr: str, name: str, places: int = 6) -> str:
    return f"round_even(({expr})::DOUBLE, {places}) AS {name}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RELATIONS = {
    "rental": """
        SELECT rental_id, rental_date, customer_id, inventory_id,
               CASE WHEN hours_out IS NOT NULL THEN rental_date + to_hours(hours_out) END AS return_date
        FROM (
            SELECT ((l_orderkey*10+l_linenumber)*100000+l_partkey)*10000+l_suppkey AS rental_id,
                   o_orderdate + to_minutes(((l_partkey*37 + l_linenumber*101) % 1440)::INTEGER) AS rental_date,
                   o_custkey AS customer_id, l_partkey AS inventory_id,
                   CASE WHEN l_returnflag='N' AND l_linestatus='O' THEN NULL
                        ELSE ((1 + l_quantity::INTEGER % 10) * 24 + (l_suppkey*13) % 24)::INTEGER END AS hours_out
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "payment": """
        SELECT ((l_orderkey*10+l_linenumber)*100000+l_partkey)*10000+l_suppkey AS rental_id,
               l_extendedprice::DECIMAL(12,2) AS amount
        FROM lineitem WHERE l_discount > 0
        UNION ALL
        SELECT ((l_orderkey*10+l_linenumber)*100000+l_partkey)*10000+l_suppkey, 1.00::DECIMAL(12,2)
        FROM lineitem WHERE l_discount > 0 AND l_tax = 0.08::DOUBLE""",
    "person": """
        SELECT c_custkey AS customer_id, c_mktsegment || ' ' || c_name AS full_name,
               lower(c_name) || '@example.org' AS email,
               CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS active,
               n_name || '-' || c_mktsegment AS city, n_name AS country
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "film": """
        SELECT p_partkey AS film_id, p_name || ' #' || p_partkey AS title, p_type AS description,
               2006 AS release_year, 3 + p_size % 5 AS rental_duration,
               CASE p_partkey % 3 WHEN 0 THEN 0.99 WHEN 1 THEN 2.99 ELSE 4.99 END::DOUBLE AS rental_rate,
               46 + p_size * 2 AS length,
               CASE p_partkey % 5 WHEN 0 THEN 'G' WHEN 1 THEN 'PG' WHEN 2 THEN 'PG-13'
                    WHEN 3 THEN 'R' ELSE 'NC-17' END AS rating,
               (p_retailprice/50)::DECIMAL(12,2)::DOUBLE AS replacement_cost, p_brand AS category
        FROM part""",
    "fact": """
        SELECT r.rental_id, r.rental_date, r.return_date,
               dayofweek(r.rental_date)::INTEGER AS day_of_week_num,
               dayname(r.rental_date) AS day_of_week,
               CASE WHEN dayofweek(r.rental_date) IN (0,6) THEN 'Weekend' ELSE 'Weekday' END AS day_type,
               strftime(r.rental_date, '%Y-%m') AS rental_month,
               c.customer_id, c.full_name, c.email, c.active, c.city, c.country,
               f.film_id, f.title, f.rental_duration AS allowed_days, f.rental_rate,
               f.length AS film_length_min, f.rating, f.category, p.amount,
               date_diff('microsecond', r.rental_date, r.return_date) / 86400000000.0::DOUBLE
                   AS rental_duration_actual,
               greatest(date_diff('microsecond', r.rental_date, r.return_date)
                   - f.rental_duration * 86400000000, 0) AS overdue_us,
               CASE WHEN r.return_date IS NULL THEN NULL
                    ELSE date_diff('microsecond', r.rental_date, r.return_date)
                         > f.rental_duration * 86400000000 END AS is_late_return
        FROM rental r JOIN person c ON r.customer_id = c.customer_id
        JOIN film f ON r.inventory_id = f.film_id
        LEFT JOIN payment p ON r.rental_id = p.rental_id""",
    # --- profile ---
    "gaps": """
        SELECT customer_id, avg(date_sub('day', prev, rental_date)) AS gap
        FROM (SELECT customer_id, rental_date,
                     lag(rental_date) OVER (PARTITION BY customer_id ORDER BY rental_date, rental_id) AS prev
              FROM fact)
        WHERE prev IS NOT NULL GROUP BY customer_id""",
    "taste": """
        SELECT customer_id, category, count(*) AS n,
               row_number() OVER (PARTITION BY customer_id ORDER BY category) - 1 AS alpha_rank,
               row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, category) AS liked
        FROM fact GROUP BY customer_id, category""",
    "measures": """
        SELECT customer_id, any_value(full_name) AS full_name, any_value(city) AS city,
               any_value(country) AS country, any_value(active) AS active,
               count(*) AS total_rentals,
               coalesce(sum(amount), 0)::DOUBLE AS total_spending,
               max(rental_date) AS last_rental_date, min(rental_date) AS first_rental_date,
               count(*) FILTER (WHERE is_late_return) AS late_return_count,
               sum(overdue_us)::DOUBLE / count(*) / 86400000000.0::DOUBLE AS avg_days_overdue,
               count(*) FILTER (WHERE day_type = 'Weekend') AS weekend_rentals,
               count(DISTINCT category) AS unique_genres
        FROM fact GROUP BY customer_id""",
    "scored_plain": """
        SELECT m.*, g.gap, t.category AS top_genre,
               round_even(late_return_count::DOUBLE / total_rentals, 4) AS late_return_rate,
               round_even(unique_genres::DOUBLE / total_rentals, 4) AS genre_diversity,
               date_sub('day', last_rental_date, max(last_rental_date) OVER ()) AS days_since_last_rental,
               date_sub('day', first_rental_date, max(last_rental_date) OVER ()) AS customer_tenure_days,
               round_even(weekend_rentals::DOUBLE / total_rentals * 100, 1) AS pct_weekend,
               round_even(total_rentals::DOUBLE / greatest(
                   (year(last_rental_date)*12 + month(last_rental_date))
                   - (year(first_rental_date)*12 + month(first_rental_date)), 1), 2) AS avg_rentals_per_month
        FROM measures m LEFT JOIN gaps g ON m.customer_id = g.customer_id
        JOIN taste t ON m.customer_id = t.customer_id AND t.liked = 1""",
    "scored": """
        SELECT *, least(greatest(late_return_rate * 0.5
                  + least(greatest(avg_days_overdue, 0), 10) / 10 * 0.3
                  + least(greatest(coalesce(gap, 30.0), 0), 60) / 60 * 0.2 + NOISE, 0), 1) AS risk_score
        FROM scored_plain""",
    "cuts": """
        SELECT quantile_cont(total_spending, 0.25) AS q1, quantile_cont(total_spending, 0.5) AS q2,
               quantile_cont(total_spending, 0.75) AS q3,
               quantile_cont(days_since_last_rental::DOUBLE, 0.5) AS r_med,
               quantile_cont(total_rentals::DOUBLE, 0.5) AS f_med,
               quantile_cont(risk_score, 0.55) AS risk_cut,
               max(days_since_last_rental) AS max_days, max(total_rentals) AS max_rentals
        FROM scored""",
    "profile": """
        SELECT s.*, coalesce(gap, 0) AS avg_rental_gap_days,
               total_spending / total_rentals AS avg_spend_per_rental,
               risk_score > risk_cut AS is_high_risk,
               CASE WHEN total_spending <= q1 THEN 'Low Spender' WHEN total_spending <= q2 THEN 'Mid Spender'
                    WHEN total_spending <= q3 THEN 'High Spender' ELSE 'Top Spender' END AS spending_tier,
               CASE (days_since_last_rental <= r_med)::INTEGER + (total_rentals >= f_med)::INTEGER
                    + (total_spending >= q2)::INTEGER
                    WHEN 0 THEN 'Lost' WHEN 1 THEN 'At Risk' WHEN 2 THEN 'Loyal' ELSE 'Champions' END
                    AS rfm_segment,
               max_days, max_rentals
        FROM scored s, cuts""",
    # --- genres ---
    "moves": """
        SELECT category, next_category, count(*) AS n
        FROM (SELECT category, lead(category) OVER (PARTITION BY customer_id
                     ORDER BY rental_date, rental_id, category) AS next_category FROM fact)
        WHERE next_category IS NOT NULL GROUP BY category, next_category""",
    "transition": """
        SELECT category, next_category, n, n::DOUBLE / sum(n) OVER (PARTITION BY category) AS prob
        FROM moves""",
    "last_seen": """
        SELECT customer_id, category AS last_category, title AS last_film, rental_date AS last_date
        FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
                     ORDER BY rental_date DESC, rental_id DESC, category DESC) AS k FROM fact)
        WHERE k = 1""",
    "liking": """
        SELECT customer_id, category, (n_genres - alpha_rank)::DOUBLE / n_genres * 0.15 AS boost
        FROM (SELECT *, count(*) OVER (PARTITION BY customer_id) AS n_genres FROM taste)""",
    "candidate": """
        SELECT l.customer_id, l.last_category, l.last_film, l.last_date, t.next_category, t.n, t.prob,
               t.prob + coalesce(k.boost, 0) AS raw
        FROM last_seen l
        JOIN (SELECT *, row_number() OVER (PARTITION BY category ORDER BY prob DESC, next_category) AS pos
              FROM transition) t ON l.last_category = t.category AND t.pos <= 8
        LEFT JOIN liking k ON k.customer_id = l.customer_id AND k.category = t.next_category""",
    "predicted": """
        SELECT *, round_even(raw / total, 12) AS adjusted_prob,
               row_number() OVER (PARTITION BY customer_id
                   ORDER BY round_even(raw / total, 12) DESC, next_category) AS position
        FROM (SELECT *, sum(raw) OVER (PARTITION BY customer_id) AS total FROM candidate)""",
    # --- churn ---
    "churn_raw": """
        SELECT *, days_since_last_rental::DOUBLE / max_days * 0.6 + (CHURNTERM)
               + CASE rfm_segment WHEN 'Lost' THEN 1.0 WHEN 'At Risk' THEN 0.6 WHEN 'Loyal' THEN 0.2
                      ELSE 0.0 END::DOUBLE * 0.15 AS raw_score FROM profile""",
    "churn": """
        SELECT *, round_even(least(greatest(raw_score, 0), 1), 3) AS churn_score,
               CASE WHEN round_even(least(greatest(raw_score, 0), 1), 3) <= 0 THEN NULL
                    WHEN round_even(least(greatest(raw_score, 0), 1), 3) <= 0.33 THEN 'Low Churn Risk'
                    WHEN round_even(least(greatest(raw_score, 0), 1), 3) <= 0.66 THEN 'Medium Churn Risk'
                    ELSE 'High Churn Risk' END AS churn_risk_label
        FROM churn_raw""",
}

NOISE_SQL = """sqrt(-2.0 * ln((('0x' || substr(md5(customer_id || ':42'), 1, 8))::BIGINT::DOUBLE + 1.0) / 4294967296.0))
    * cos(6.283185307179586 * (('0x' || substr(md5(customer_id || ':42'), 9, 8))::BIGINT::DOUBLE / 4294967296.0)) * 0.03"""
CHURN_OBSERVED = "1 - total_rentals::DOUBLE / max_rentals * 0.25"
CHURN_INTENDED = "(1 - total_rentals::DOUBLE / max_rentals) * 0.25"


def statement(select: str, noise: str = NOISE_SQL, churn: str = CHURN_OBSERVED) -> str:
    """``select`` over the expressions above, keeping those it needs."""
    import re

    def mentions(text: str) -> set[str]:
        return {n for n in RELATIONS if re.search(rf"\b(FROM|JOIN|,)\s+{n}\b", text)}

    wanted: set[str] = set()
    todo = mentions(select)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo |= mentions(RELATIONS[name])
    ctes = ",\n".join(
        f"{n} AS MATERIALIZED ({RELATIONS[n].replace('NOISE', noise).replace('CHURNTERM', churn)})"
        for n in RELATIONS
        if n in wanted
    )
    return f"WITH {ctes}\n{select}" if ctes else select


def text(template: str, **values: str) -> str:
    """``template`` as a SQL expression with ``{name}`` replaced by expressions."""
    expression = quoted(template)
    for name, value in values.items():
        expression = expression.replace("{" + name + "}", f"' || ({value}) || '")
    return expression


def values(column: str, names: list[str]) -> str:
    rows = ", ".join(f"({quoted(n)}, {i})" for i, n in enumerate(names))
    return f"(VALUES {rows}) AS v({column}, position)"


__all__ = [
    "CHURN_INTENDED", "CHURN_OBSERVED", "NOISE_SQL", "labels", "quoted", "r", "statement", "text", "values",
]
