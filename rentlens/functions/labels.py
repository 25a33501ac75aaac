"""Fixed values of the business rules: names, weights, texts.

Everything here has to be worded exactly so for results to agree, and is
therefore kept as plain text in one place. ``{name}`` marks a value that the
plans fill in.
"""

from __future__ import annotations

# --- Fixed values: category names of the derived columns -------------------

SEGMENTS_BY_SCORE = ["Lost", "At Risk", "Loyal", "Champions"]
SEGMENT_ORDER = ["Champions", "Loyal", "At Risk", "Lost"]
TIER_ORDER = ["Low Spender", "Mid Spender", "High Spender", "Top Spender"]
DAY_ORDER = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
CHURN_ORDER = ["High Churn Risk", "Medium Churn Risk", "Low Churn Risk"]

# Churn weight of each segment, and upper bounds of the bands.
CHURN_WEIGHTS = {"Lost": 1.0, "At Risk": 0.6, "Loyal": 0.2, "Champions": 0.0}
CHURN_BANDS = [(0.33, "Low Churn Risk"), (0.66, "Medium Churn Risk"), (1.01, "High Churn Risk")]

# Film notes and risk labels.
NOTE_SHORT, NOTE_PREMIUM, NOTE_MATCH = "✅ Short-term", "⭐ Premium", "👍 Match"
RISK_HIGH, RISK_LOW = "🔴 High Risk", "🟢 Low Risk"

# --- Fixed values: model inputs --------------------------------------------

FEATURE_LABELS = {
    "total_rentals": "Total Rentals",
    "avg_days_overdue": "Avg Days Overdue",
    "late_return_count": "Late Return Count",
    "late_return_rate": "Late Return Rate",
    "total_spending": "Total Spending ($)",
    "avg_rental_gap_days": "Avg Rental Gap (days)",
    "days_since_last_rental": "Days Since Last Rental",
    "genre_diversity": "Genre Diversity Score",
}
FEATURE_SETS = {
    "Logistic Regression": ["total_rentals", "total_spending", "days_since_last_rental"],
    "Random Forest": [
        "total_rentals", "avg_days_overdue", "late_return_count", "late_return_rate",
        "total_spending", "avg_rental_gap_days", "days_since_last_rental",
    ],
    "Gradient Boosting": [
        "total_rentals", "avg_days_overdue", "late_return_count", "late_return_rate",
        "total_spending", "avg_rental_gap_days", "days_since_last_rental", "genre_diversity",
    ],
}

# --- Fixed values: texts of the action cards (title, body) -----------------

IMMEDIATE = {
    "remind": (
        "📱 Send Return Reminder",
        "This customer has a {late_pct}% late return rate. "
        "Set up an automated SMS/email reminder 1 day before each due date immediately.",
    ),
    "reactivate": (
        "📧 Re-activation Email",
        "Last rental was {days} days ago — this customer is drifting. "
        "Send a personalised 'We miss you' email with a 15% discount voucher today.",
    ),
    "win_back": (
        "🎁 Win-Back Offer",
        "Customer has been inactive for {days} days. "
        "A bold offer (e.g. 1 free rental) is needed to re-activate before permanent churn.",
    ),
    "none": (
        "✅ No Urgent Action Needed",
        "This customer is currently engaged. Maintain relationship with regular communication.",
    ),
}
SHORT_TERM = {
    "vip": (
        "🏆 Enrol in VIP Loyalty Programme",
        "This customer has rented {rentals} times and is a top spender ({tier}). "
        "Invite them to an exclusive VIP tier with early access to new releases.",
    ),
    "limit": (
        "📋 Limit Concurrent Rentals",
        "Cap at 2 active rentals until on-time return rate improves. "
        "Review monthly — restore full access when late rate drops below 20%.",
    ),
    "upsell": (
        "⬆️ Upsell to Premium Plan",
        "Loyal customer with {tier} spending. Offer a subscription plan "
        "or 'rent 5 get 1 free' card to increase visit frequency.",
    ),
    "promote": (
        "🎯 Genre-Targeted Promotion",
        "Customer prefers {genre}. Send a curated list of new arrivals "
        "in their favourite genre with a limited-time discount to re-engage.",
    ),
    "none": (
        "📊 Monitor Engagement",
        "Track rental frequency monthly. If gap between rentals widens by 50%, "
        "escalate to an At-Risk re-engagement campaign.",
    ),
}
LONG_TERM = {
    "lifetime": (
        "💰 Maximise Lifetime Value",
        "At {tier} level, this customer is high-value. "
        "Build a long-term relationship through personalised outreach, "
        "birthday offers, and exclusive catalogue previews.",
    ),
    "broaden": (
        "🎭 Broaden Genre Exposure",
        "Genre diversity score: {diversity} — customer rents from "
        "a narrow set of genres. Gradual cross-genre recommendations can increase "
        "basket size and long-term retention.",
    ),
    "prevent": (
        "🔄 Churn Prevention System",
        "Flag this customer in the automated churn monitoring system. "
        "If no rental in the next 30 days, trigger escalated intervention workflow.",
    ),
    "none": (
        "🌱 Develop Brand Loyalty",
        "Consistently engaged customers become brand advocates. "
        "A referral programme ('refer a friend, both get a free rental') "
        "can turn this customer into a growth channel.",
    ),
}
SEGMENT_ACTIONS = {
    "Champions": (
        "Reward Champions",
        "{n} customers. VIP early access, loyalty card, exclusive new-release previews. "
        "Goal: maintain engagement and prevent churn.",
    ),
    "At Risk": (
        "Re-engage At-Risk",
        "{n} customers. 'We miss you — 15% off your next rental.' "
        "Personalise with their favourite genres.",
    ),
    "Lost": (
        "Win Back Lost",
        "{n} customers. Bold offer: one free rental. Focus on past high-spenders first.",
    ),
}
RISK_ACTIONS_HIGH = [
    (
        "Send Return Reminder",
        "Top driver: {driver} ({share}%). "
        "Enable automated SMS/email 1 day before due date for this customer. "
        "Cost: near-zero. Expected outcome: reduce overdue days immediately.",
    ),
    (
        "Offer On-Time Incentive",
        "Reward the next 3 on-time returns with 10% off the following rental. "
        "Behavioural nudge — positive reinforcement is more effective than penalties.",
    ),
    (
        "Limit Concurrent Rentals",
        "Cap at 2 active rentals until behaviour improves. "
        "Review status monthly. If late rate drops below 20%, restore full access.",
    ),
]
RISK_ACTIONS_LOW = [
    (
        "Offer Premium or Extended Plan",
        "This customer is reliable. Offer longer rental periods "
        "(7+ days) and premium-rate titles. Low risk = high trust = upsell opportunity.",
    ),
    (
        "Enrol in Loyalty Programme",
        "Reliable customers enrolled in loyalty schemes have "
        "significantly higher lifetime value. Target for VIP membership invitation.",
    ),
    (
        "Use as Brand Advocate",
        "Low-risk, high-frequency customers are ideal referral sources. "
        "A 'refer a friend' programme with a shared discount can expand your base.",
    ),
]
NEXT_GENRE_ACTIONS = [
    (
        "Personalised Recommendation Email",
        "Send {name} an email today featuring new {next} titles. "
        "Personalised outreach has 3–6× higher click-through than generic campaigns.",
    ),
    (
        "In-Store / App Cross-Sell",
        "When {name} returns a {last} film, automatically surface {next} suggestions at "
        "checkout. Contextual prompts increase basket size by 15–25% on average.",
    ),
    (
        "Genre Affinity Programme",
        "Customers who frequently transition {last} → {next} "
        "form a natural affinity cluster. Build a segment-level campaign "
        "targeting all such customers for sustained revenue growth.",
    ),
]
CHURN_ACTIONS = [
    (
        "Contact Top 10 Churn Risks Today",
        "The top 10 customers represent significant revenue. "
        "A personal outreach (phone or email) with a special offer "
        "has the highest chance of recovery for high-value churners.",
    ),
    (
        "Launch Re-activation Campaign",
        "${revenue} in revenue is at risk from high-churn customers. "
        "A targeted email campaign with a 'come back' offer can recover 15–30% "
        "of lapsed revenue.",
    ),
    (
        "Build Churn Early-Warning System",
        "Automate monthly churn scoring. Flag any customer whose recency "
        "doubles (e.g. from 14 to 28 days gap) for proactive outreach. "
        "Prevention costs 5× less than re-acquisition.",
    ),
]
TIERS = ["Immediate", "Short-Term", "Long-Term"]
