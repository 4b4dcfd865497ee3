"""Query catalogue: one DataFrame plan and one SQL text for each operator."""
