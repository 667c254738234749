"""Session set-up and plan-level helpers."""
