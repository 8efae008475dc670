"""Questions as plans: which rows, which grouping, which operator."""
