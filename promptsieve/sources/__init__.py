"""Where prompts come from and where results go."""
