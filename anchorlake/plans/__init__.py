"""End-to-end plans and the registered queries that exercise every operator."""
