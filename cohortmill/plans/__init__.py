def load() -> None:
    """Import every module that registers queries."""
    from importlib import import_module

    for name in ("matching_queries", "runs_queries", "text_queries", "coding_queries", "export_queries", "intake_queries"):
        import_module(f"cohortmill.plans.{name}")
