"""Policy, vocabulary and the schema-driven plan compiler."""
