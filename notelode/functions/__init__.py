"""Column expressions; every function takes and returns ``Column`` unless it says otherwise."""
