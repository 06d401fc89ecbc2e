"""Ready-made queries over the driver's tables, and registries of interchangeable parts."""
