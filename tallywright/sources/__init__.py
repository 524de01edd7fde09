"""Where contributions come from and where they are kept."""
